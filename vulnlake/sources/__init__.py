"""Readers and writers of corpora, metadata and findings."""
