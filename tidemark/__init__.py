"""A Spark-first engine for public text signals."""
