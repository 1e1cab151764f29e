"""Lodestone: a Spark-first engine for document corpora (retrieval, evaluation, verification, operations)."""
