"""Operators for preparing language-model training data.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which counts as
part of it) imports it.  Every operator takes and returns DataFrames.
"""
