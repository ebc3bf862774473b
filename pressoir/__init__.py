"""Pressoir: a PySpark-native retrieval and text-processing engine for press archives."""
