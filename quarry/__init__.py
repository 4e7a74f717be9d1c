"""quarry: a Spark-first text retrieval and corpus analytics engine."""
