"""Operators for preparing training data: filters, near-duplicates, packing, archives, search.

Nothing else in the library imports this subpackage.
"""
