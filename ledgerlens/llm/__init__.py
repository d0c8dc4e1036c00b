"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` registers its
queries when it can be imported.
"""
