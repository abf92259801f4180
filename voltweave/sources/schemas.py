"""Explicit schemas of the logical tables."""

AVAILABILITIES = "event_id long, station_id long, site_id long, ts timestamp_ntz, status string"
STATIONS = "station_id long, site_id long, name string, lat double, lon double, kw_rated double, installation_status string, provider_deleted int"
SITES = "site_id long, provider_deleted int"
TOWNS = "town_id long, name string, lat double, lon double, population long"
HUBS = "hub_id long, name string, island string, lat double, lon double"
AREAS = "area_id long, name string, year int, population_estimate double, lat double, lon double"
HIGHWAYS = "road_id long, parts array<array<struct<lon: double, lat: double>>>, free_flow_speed double, traffic_volume double"
NODES = "node_id long, lat double, lon double, traffic_volume double, free_flow_speed double"
EDGES = "src long, dst long, length double, time double"
GEONAMES = "geonames array<struct<name: string, lat: string, lng: string, population: long, fcl: string>>"
