"""termflow: a Spark-native text and vocabulary analytics engine."""
