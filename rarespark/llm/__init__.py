"""Training-data operators: scoring, filtering, deduplication, search, sharding, tokenisation.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
