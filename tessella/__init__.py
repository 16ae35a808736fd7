"""Tessella: retrieval analytics over text corpora, expressed as Spark DataFrame plans."""
