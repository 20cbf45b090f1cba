"""Operators for preparing training data: repeats, quality, leaks, near copies, packing, scans and archives."""
