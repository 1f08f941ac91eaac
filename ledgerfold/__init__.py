"""ledgerfold: Spark-native analytics over bibliographic records."""
