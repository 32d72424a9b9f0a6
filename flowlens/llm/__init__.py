"""Operators for training-data pipelines over documents, pages, embeddings and conversations."""
