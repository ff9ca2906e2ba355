"""Operators for large text corpora: filtering, near-duplicate search, tokenising and formatting.

Each module holds one operator with its own interface plus the thin ``opN_*`` query on top of it.
Nothing outside this subpackage imports it.
"""
