"""Memory search, enrichment and statistics as Spark jobs."""
