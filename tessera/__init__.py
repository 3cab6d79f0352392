"""tessera: a Spark-first knowledge-retrieval and corpus-analytics engine."""
