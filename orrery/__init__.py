"""orrery: a Spark-native analytics engine for a hierarchical 3-D catalogue."""
