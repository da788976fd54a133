"""Archived-document analytics on Spark: collect, extract, version and search."""
