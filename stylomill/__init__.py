"""stylomill: Spark-native corpus preparation and authorship-verification analytics."""
