"""lodestone: evidence retrieval and analytics over document corpora as Spark DataFrame jobs."""
