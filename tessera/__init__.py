"""Spark-native engine for document corpora: derivation, retrieval, audit and comparison."""
