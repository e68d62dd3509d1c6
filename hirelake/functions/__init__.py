"""Column-level building blocks. Everything here returns Spark Columns."""
