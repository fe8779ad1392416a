"""Sensor-telemetry analytics for pumped reservoirs, as Spark DataFrame jobs."""
