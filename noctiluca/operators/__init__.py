"""Relational and numerical operators over papers, vectors and retrieval results."""
