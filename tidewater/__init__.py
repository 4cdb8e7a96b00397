"""Tidewater: ordered, tabular and market-style time-series analytics on Spark."""
