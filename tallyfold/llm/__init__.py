"""Operators for large text corpora: token files, scans, near-duplicates, search, quality."""
