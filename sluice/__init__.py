"""sluice: a Spark-native engine for partitioned message logs and their analytics."""
