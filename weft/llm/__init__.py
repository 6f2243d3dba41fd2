"""Operators for training-data pipelines: corpus operators and their queries.

Nothing outside this folder imports it.
"""
