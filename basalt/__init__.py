"""basalt: a Spark-native engine for shelf-audit analytics and training-data preparation."""
