"""A Spark-native engine for molecular and set-similarity analytics at table scale."""
