"""Options-market analytics and data processing expressed as Spark jobs."""
