"""Similarity, clustering, naming, link planning, merging and sinks."""
