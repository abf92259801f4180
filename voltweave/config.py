"""Parameters of the analytics, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

AVAILABLE, OCCUPIED, UNAVAILABLE = "Available", "Occupied", "Unavailable"
STATUSES = (AVAILABLE, OCCUPIED, UNAVAILABLE)

# The ring (lon, lat) that is taken for the South Island, and the share of electric cars by year.
SOUTH_RING = ((174.285767, -47.484937), (174.580971, -40.132815), (164.326542, -40.013923), (164.544060, -47.934484))
EV_SHARE = {
    2023: 0.01484, 2024: 0.01980, 2025: 0.02801, 2026: 0.04180, 2027: 0.06163, 2028: 0.08915, 2029: 0.12119,
    2030: 0.15614, 2031: 0.19318, 2032: 0.23240, 2033: 0.27322, 2034: 0.31466, 2035: 0.35721, 2036: 0.40091,
    2037: 0.44594, 2038: 0.49056, 2039: 0.53385, 2040: 0.57599, 2041: 0.61633, 2042: 0.65472, 2043: 0.69237,
    2044: 0.72888, 2045: 0.76285, 2046: 0.79427, 2047: 0.82317, 2048: 0.84958, 2049: 0.87358, 2050: 0.89502,
}
#: Mean Earth radius in km.
EARTH_KM = 6371.0088


@dataclass(frozen=True)
class Params:
    zone: str = "Pacific/Auckland"
    population_threshold: int = 2000
    resample_minutes: int = 10
    max_plausible_hours: float = 24.0
    iqr_multiplier: float = 4.0
    queue_minutes: float = 5.0
    charger_gap_km: float = 75.0
    hub_gap_km: float = 200.0
    min_transitions: int = 30
    facility_km: float = 20.0
    road_km: float = 10.0
    neighbor_km: float = 25.0
    weight: str = "time"
    town_link_weight: float = 1.0
    contract_km: float = 1.0
    stitch_km: float = 20.0
    stitch_factor: float = 2**0.5
    stitch_speed: float = 100.0
    patch_speed: float = 50.0
    peak_ratio: float = 2.5
    benefit: float = 15000.0
    public_share: float = 0.15
    charges_per_day: float = 0.4
    travel_rate: float = 0.67
    year: int = 2023


DEFAULTS = Params()
