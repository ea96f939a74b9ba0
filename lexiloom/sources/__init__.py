"""Readers and writers of the corpus and its text files."""
