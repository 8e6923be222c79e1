"""Code-graph analytics as Spark DataFrame jobs."""
