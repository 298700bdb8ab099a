"""Relational building blocks of retrieval: filters, chunking, BM25, dense search, fusion, ranking."""
