"""Area-level evidence analytics as Spark jobs."""
