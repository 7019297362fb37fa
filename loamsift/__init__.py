"""Hybrid document retrieval and its evaluation on Spark."""
