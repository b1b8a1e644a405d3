"""Operators of a training-data pipeline: filtering, near-duplicates, scans, sharding, packing.

Nothing else in the library imports this package.
"""
