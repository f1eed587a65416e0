"""Document understanding and record linkage as Spark DataFrame jobs."""
