"""Customer feature tables and checked credit decisions as Spark DataFrame jobs."""
