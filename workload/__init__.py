"""Views of the driver tables as telemetry, the registered queries and their SQL checks."""
