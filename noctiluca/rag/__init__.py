"""Chunks, lexical and dense retrieval, and the question benchmark."""
