"""Column builders. All of them are plain Spark expressions."""
