"""Block-level location analytics as composable Spark DataFrame transformations."""
