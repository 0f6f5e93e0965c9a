"""Training-data operators: filtering, scoring, deduplication, sharding and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
