"""Operators of a training-data pipeline: search, fingerprints, duplicates, quality, mixing, tokens, shards.

Nothing outside this folder imports it.
"""
