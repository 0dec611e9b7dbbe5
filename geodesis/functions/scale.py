"""Factors that turn summed dependencies into centralities.

Sums run over ordered pairs, so an undirected pair is counted from both ends;
the normalizing factors below take that into account for both kinds of graph.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_scale(n: int, normalized: bool, directed: bool, k: int | None = None) -> float | None:
    """Factor for node scores, ``None`` to leave them alone. The correction for
    ``k`` sampled sources applies only where there is a factor to correct."""
    if normalized:
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else None
    else:
        scale = None if directed else 0.5
    if scale is None or k is None:
        return scale
    return scale * n / k


def edge_scale(n: int, normalized: bool, directed: bool) -> float | None:
    """Factor for edge scores, ``None`` to leave them alone."""
    if normalized:
        return 1.0 / (n * (n - 1)) if n > 1 else None
    return None if directed else 0.5


def rescaled(column: Column, scale: float | None) -> Column:
    return column if scale is None else column * F.lit(scale)
