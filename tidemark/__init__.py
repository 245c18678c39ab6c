"""Tidemark: software-history and training-data analytics as Spark plans."""
