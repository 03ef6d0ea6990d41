"""Tidewell: entity-by-day longitudinal analytics as lazy Spark plans."""
