"""Semantic-graph and data-quality operators as PySpark DataFrame programs."""
