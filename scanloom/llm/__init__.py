"""Operators that prepare training text: packing, formatting, sharding, de-duplication, quality, mixing."""
