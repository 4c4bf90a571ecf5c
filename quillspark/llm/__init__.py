"""Training-data operators: packing, deduplication, filtering, sharding, scanning, scoring and counting.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries and their SQL.
"""
