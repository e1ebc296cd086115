"""tarsus: Spark-native paired-evaluation analytics."""
