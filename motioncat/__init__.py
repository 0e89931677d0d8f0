"""Clip-catalog analytics on Spark: selectors, rollups, tags, tracks and embeddings."""
