"""Ordered sequences and corpora on PySpark."""
