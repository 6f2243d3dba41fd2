"""Spark jobs over a linked-data index: keys, triples, statistics, search, graph, admission and erasure."""
