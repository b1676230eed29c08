"""Readers and writers of corpora, queries, judgements, metadata and results."""
