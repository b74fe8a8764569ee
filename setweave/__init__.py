"""Spark-native analytics over set-similarity graphs, embeddings and text corpora."""
