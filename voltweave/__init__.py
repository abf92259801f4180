"""Charger-network analytics as Spark DataFrame transformations."""
