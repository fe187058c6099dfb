"""Operators over DataFrames: search, fusion, ranking, discovery, evaluation, corpora, lineage, DDL."""
