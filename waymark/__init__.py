"""A Spark-native engine for geographic feature tables and road networks."""
