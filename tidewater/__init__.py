"""Tidewater: review analytics as Spark DataFrame jobs."""
