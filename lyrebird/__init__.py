"""A Spark-native engine for the data plane of speech and text corpora."""
