"""Answering questions over an index: tools that return DataFrames, response envelopes and guards."""
