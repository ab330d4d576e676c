"""Operators for training data: copies, percentiles, packing, mixing, garbled text. Nothing outside this folder imports it."""
