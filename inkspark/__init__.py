"""A Spark-native engine for optical-character-recognition dataflow and the analytics around it."""
