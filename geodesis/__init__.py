"""Shortest-path centrality of graphs held as Spark DataFrames."""

from geodesis.graph import (
    Graph,
    adjacency,
    arcs,
    neighbours,
    sorted_edges,
    sorted_vertices,
)
from geodesis.operators.components import component_sizes, connected_components
from geodesis.operators.field import Limits
from geodesis.operators.pivots import sample_vertices
from geodesis.plans.centrality import (
    betweenness,
    betweenness_centrality,
    edge_betweenness,
    edge_betweenness_centrality,
    node_betweenness,
    node_betweenness_centrality,
    predecessors,
    shortest_paths,
    source_dependencies,
)
from geodesis.plans.communities import EdgeRemoval, remove_edges, top_edge
from geodesis.sources.sinks import (
    write_betweenness,
    write_edge_scores,
    write_node_scores,
)
from geodesis.sources.text import read_adjacency_list, read_edge_list, read_graph
from geodesis.workspace import release_tables

__all__ = [
    "EdgeRemoval",
    "Graph",
    "Limits",
    "adjacency",
    "arcs",
    "betweenness",
    "betweenness_centrality",
    "component_sizes",
    "connected_components",
    "edge_betweenness",
    "edge_betweenness_centrality",
    "neighbours",
    "node_betweenness",
    "node_betweenness_centrality",
    "predecessors",
    "read_adjacency_list",
    "read_edge_list",
    "read_graph",
    "release_tables",
    "remove_edges",
    "sample_vertices",
    "shortest_paths",
    "sorted_edges",
    "sorted_vertices",
    "source_dependencies",
    "top_edge",
    "write_betweenness",
    "write_edge_scores",
    "write_node_scores",
]
