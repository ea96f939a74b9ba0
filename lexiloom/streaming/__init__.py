"""Incremental building of the corpus."""
