"""Lodestone: retrieval analytics over catalogs, vectors and text, as lazy Spark plans."""

__version__ = "0.1.0"
