"""Operators for preparing language-model training data.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; every
operator takes DataFrames and returns DataFrames.
"""
