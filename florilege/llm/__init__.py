"""Operators for preparing training data: near-duplicates, quality, personal data, packing, tokenizing, archives.

Nothing else in the library imports this subpackage.
"""
