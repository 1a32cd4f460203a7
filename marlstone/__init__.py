"""A Spark-native engine for versioned, content-addressed knowledge bases."""
