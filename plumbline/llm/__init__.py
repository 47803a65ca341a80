"""Training-data operators: scans, codecs, classifiers, near-duplicate joins, packing and formatting.

Nothing outside this subpackage imports it; `__spark_entry__` adds its queries only when it is there.
"""
