"""Operators for large text corpora: filtering, extraction, deduplication, scoring, mixing.

Nothing outside this subpackage imports it.
"""
