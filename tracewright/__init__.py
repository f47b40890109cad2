"""tracewright: trajectory and training-data analytics as plain Spark DataFrame operators."""
