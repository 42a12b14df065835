"""Operators for preparing text corpora: scoring, finding, de-duplicating, mixing and packing.

Nothing outside this folder and `corpus_pipeline.py` imports it.
"""
