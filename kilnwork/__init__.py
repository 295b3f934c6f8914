"""Spark-first engine for catalogues of documents and their semantic trees."""
