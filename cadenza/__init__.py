"""Motion time-series analytics as plain Spark DataFrame operators."""
