"""docengine: a Spark-native engine for JSON-shaped documents."""
