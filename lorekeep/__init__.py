"""Document search and chat answering expressed as Spark DataFrame jobs."""
