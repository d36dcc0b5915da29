"""Training-data operators: archives, tokenising, packing, deduplication, filtering and formatting.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
