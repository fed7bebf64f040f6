"""Training-data operators: counting, packing, scoring, search, near-duplicate and mixing stages.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
