"""Operators for preparing training corpora.

Self-contained: nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
