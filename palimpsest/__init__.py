"""Retrieval, memory and corpus analytics on Spark."""
