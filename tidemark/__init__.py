"""tidemark: point-in-time machine-learning data work on event tables, as Spark jobs."""
