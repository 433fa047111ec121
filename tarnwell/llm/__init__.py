"""Training-data operators: deduplication, scoring, filtering, mixing and packing of text corpora.

Nothing outside this folder imports it, so the rest of the library works without it.
"""
