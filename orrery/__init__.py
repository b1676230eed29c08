"""Retrieval analytics and document processing as Spark plans."""
