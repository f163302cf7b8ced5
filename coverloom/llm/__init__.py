"""Operators for preparing training text: deduplication, filtering, sharding, packing and scoring.

Nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""
