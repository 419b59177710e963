"""A Spark-native engine for keyed tables, ordered sets, tensors, graphs and composable operations."""
