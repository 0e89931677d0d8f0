"""Operators that prepare text, pages and embeddings for model training."""
