"""Operators of a training-data pipeline: quality, near-duplicates, packing, archives, shards, chats and tokens."""
