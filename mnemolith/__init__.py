"""Spark-native retrieval and ranking over agent memories, an entity graph and version history."""
