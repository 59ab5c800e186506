"""Catalog curation and data-quality queries on PySpark DataFrames."""
