"""Training-data operators: dedup, secret scans, extraction, quality, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Every operator takes DataFrames and column names, selects only the columns it
needs under its own names (extra or clashing columns never matter) and returns
a DataFrame.
"""
