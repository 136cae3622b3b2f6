"""Fleet-scale analytics over captured database-server telemetry, on Spark."""

__version__ = "0.1.0"
