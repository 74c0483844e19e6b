"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
