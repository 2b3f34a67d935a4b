"""Training-data operators over documents, pages and embeddings.

Nothing outside this subpackage (and the top-level ``corpus_pipeline.py``) imports it.
"""
