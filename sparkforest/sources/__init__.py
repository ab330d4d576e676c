"""Readers and writers of graph files and batches."""

from sparkforest.sources.graph_files import declared_size, read_batch, read_egr, read_graph, read_pairs, write_batch, write_egr, write_graph, write_records

__all__ = ["declared_size", "read_batch", "read_egr", "read_graph", "read_pairs", "write_batch", "write_egr", "write_graph", "write_records"]
