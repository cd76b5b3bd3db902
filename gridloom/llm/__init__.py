"""Training-data operators: text quality, de-duplication, privacy, packing.

Nothing outside this subpackage imports it.
"""
