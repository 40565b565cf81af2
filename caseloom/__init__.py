"""caseloom: Spark-native analytics for evidence-linked nested records."""
