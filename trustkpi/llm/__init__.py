"""Operators of a training-data pipeline: scans, filters, duplicates, mixing, formatting, sharding.

Nothing else in the library imports this subpackage.
"""
