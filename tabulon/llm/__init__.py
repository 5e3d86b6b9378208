"""Operators for training-data pipelines over documents, benchmarks, labels and embeddings."""
