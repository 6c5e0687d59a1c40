"""Probabilistic tables and data preparation as Spark DataFrame operators."""
