"""touchline: point-in-time sports analytics as Spark DataFrame functions."""
