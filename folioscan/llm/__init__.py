"""Operators for preparing training text: scans, filters, near-duplicates and mixing."""
