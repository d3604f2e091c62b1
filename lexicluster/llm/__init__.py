"""Training-data operators: scoring, deduplication, search, extraction, mixing, filtering,
tokenising and sharding of document collections.

Nothing else in the library imports this subpackage.
"""
