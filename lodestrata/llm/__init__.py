"""Operators for preparing training data: deduplication, packing, tokenizing, archives, PII, classifiers, search.

Nothing outside this subpackage imports it.
"""
