"""Operators of a training-data pipeline: dedup, classifiers, scans, mixing, token files."""
