"""Training-data operators: packing, mixing, deduplication, formatting, media, token files, filters.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when present.
"""
