"""Retrieval, product-knowledge and usage analytics as Spark jobs."""
