"""Training-data operators: deduplication, filtering, packing, search and archives.

Nothing outside this folder imports it; the rest of the package works without it.
"""
