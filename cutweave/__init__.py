"""cutweave: a PySpark-native graph clustering and analytics engine."""
