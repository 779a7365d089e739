"""Catalog, evidence and evaluation analytics as Spark DataFrame operators."""
