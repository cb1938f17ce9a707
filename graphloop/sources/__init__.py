"""Readers and writers: adjacency text, generated graphs, record text with multisets, delimited files, tables, snapshots."""

from graphloop.sources.graphs import range_vertices, read_adjacency_text, replicate, ring, write_vertices
from graphloop.sources.records import file_splits, parse_records, read_blocks, read_delimited, read_labelled_sparse, read_records, read_splits

__all__ = ["file_splits", "parse_records", "range_vertices", "read_adjacency_text", "read_blocks", "read_delimited", "read_labelled_sparse", "read_records", "read_splits", "replicate", "ring", "write_vertices"]
