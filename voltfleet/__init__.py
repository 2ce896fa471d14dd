"""Energy telemetry analytics for fleets of microgrids, on Spark."""
