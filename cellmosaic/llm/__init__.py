"""Training-data operators: quality, deduplication, mixing, extraction, archives, secrets and packing.

Nothing outside this subpackage imports it.
"""
