"""Operators of a training-data pipeline: filters, duplicate removal, secrets, languages, mixing, sharding, packing."""
