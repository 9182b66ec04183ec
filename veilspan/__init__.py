"""veilspan: a Spark-native engine for personal-data spans in large document collections."""
