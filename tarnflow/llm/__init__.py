"""Training-data operators: dedup, mixing, fingerprints, token files, filters and packing.

Nothing outside this subpackage imports it. ``queries`` holds the registered
``opN_*`` queries, and the SQL for those that SQL can express.
"""
