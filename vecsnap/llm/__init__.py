"""Operators for training-data tables: ``documents`` in, one row per document or finding out."""
