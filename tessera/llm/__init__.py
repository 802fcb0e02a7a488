"""Training-data operators: mixing, dedup, search, scoring, extraction, sharding.

Nothing outside this folder imports it.
"""
