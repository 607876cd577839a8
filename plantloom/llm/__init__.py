"""Operators of a training-data pipeline: sharding, mixing, joins, scoring, search, packing."""
