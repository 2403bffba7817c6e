"""Training-data operators: cleaning, scoring, deduplication, mixing and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
