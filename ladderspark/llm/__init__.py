"""Operators for preparing training text: deduplication, fingerprints, scans, tokenizing, scoring, filtering and mixing.

Nothing else in the library imports this subpackage.
"""
