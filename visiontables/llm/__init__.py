"""Operators for training-data corpora: quality, duplicates, licences, languages, mixing and packing."""
