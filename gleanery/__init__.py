"""gleanery: Spark-native retrieval, ranking, resolution and audit of textual evidence."""
