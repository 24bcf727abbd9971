"""Operators for preparing text corpora and matching records.

Nothing outside this subpackage imports it; it may be removed without touching the core library.
"""
