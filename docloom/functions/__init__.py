"""Column functions, all built from Spark SQL functions."""
