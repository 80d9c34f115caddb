"""tessera: Spark-native record linkage, from noisy records to a consistent match set."""
