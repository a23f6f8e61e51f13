"""Inspect, score and clean tables of any size with Spark."""
