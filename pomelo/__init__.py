"""pomelo: recommendation analytics as Spark DataFrame jobs."""
