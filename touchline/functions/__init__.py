"""Column builders: every function here returns native Spark columns."""
