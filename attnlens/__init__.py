"""attnlens: attention diagnostics and training-data operators as Spark jobs."""
