"""Brindle: retrieval, reconciliation and rule pipelines as Spark DataFrame plans."""
