"""Training-data operators: sharding, mixing, tokenising, filtering and deduplication.

Nothing else in the library imports this subpackage.
"""
