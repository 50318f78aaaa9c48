"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries only when it can be imported.
"""
