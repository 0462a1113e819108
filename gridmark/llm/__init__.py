"""Operators for training-data pipelines: scoring, dedup, packing, encoding, search, sharding.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
