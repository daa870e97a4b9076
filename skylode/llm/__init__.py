"""Operators for building training corpora: cleaning, deduplicating, searching, mixing and encoding documents.

Nothing outside this subpackage imports it. Every operator takes DataFrames with the columns it names and
ignores any others; null texts count as empty ones and empty tables give empty results.
"""
