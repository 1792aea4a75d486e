"""Training-data operators: mixing, dedup, filters, scoring, tokenised output.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
