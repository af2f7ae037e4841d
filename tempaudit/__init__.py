"""Process-telemetry compliance on Spark: every run of a sensor-log corpus judged in one job."""
