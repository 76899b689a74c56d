"""Training-data operators: scoring, fingerprints, deduplication, filters and mixing.

Nothing outside this subpackage imports it; ``queries`` holds the driver queries.
"""
