"""Training-data operators: deduplication, archives, scoring, mixing and tokenisation of text corpora.

Nothing outside this package imports it.
"""
