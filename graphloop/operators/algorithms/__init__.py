"""The algorithm library: graph programs as columns, and learning loops."""

from graphloop.operators.algorithms.propagation import bfs_hops, bidirectional_meet, connected_components, min_label, reachable, shortest_paths
from graphloop.operators.algorithms.rank import pagerank, pagerank_with_status
from graphloop.operators.algorithms.structure import maximal_cliques, triangle_counts, triangle_total

__all__ = ["bfs_hops", "bidirectional_meet", "connected_components", "maximal_cliques", "min_label", "pagerank", "pagerank_with_status", "reachable", "shortest_paths", "triangle_counts", "triangle_total"]
