"""Corpus knowledge-base engine: DataFrame operators over document, chunk, graph and run tables."""
