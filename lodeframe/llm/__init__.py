"""Training-data operators: dedup, quality, privacy, packing, scoring, archives and mixing.

Nothing outside this subpackage imports it.
"""
