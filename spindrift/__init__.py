"""Gridded-motion analytics expressed as Spark DataFrame and SQL plans."""
