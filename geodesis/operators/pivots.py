"""Choice of the sources a centrality is computed or estimated from."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodesis.functions.checks import require_sample_size
from geodesis.graph import Graph

# Hex digits of a ticket that are read as a number, ranges counted at once, and
# rows of the last range that may be sorted in one place.
DIGITS = 13
BINS = 4096
MOST_SORTED = 100_000


def sample_vertices(graph: Graph, k: int, seed: int | None = None) -> DataFrame:
    """Exactly ``k`` different vertices; the same ones for the same seed,
    however the vertices are partitioned.

    They are those with the smallest tickets. The ticket of the k-th is closed
    in on by counting ranges, so only the last range is ever sorted."""
    require_sample_size(k, graph.n)
    if seed is None:
        seed = random.randrange(2**31)
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    place = F.conv(F.substring(ticket, 1, DIGITS), 16, 10).cast("long").alias("place")
    drawn = graph.vertices.select("id", ticket.alias("ticket"), place)
    low, high, wanted = 0, 16**DIGITS, k
    # The k-th smallest ticket lies in [low, high), below which `k - wanted` lie.
    rows = graph.n
    while rows > max(wanted, MOST_SORTED) and high - low > 1:
        step = -(-(high - low) // BINS)
        bins = drawn.filter((F.col("place") >= low) & (F.col("place") < high)).groupBy(
            F.floor((F.col("place") - low) / step).cast("int").alias("bin")
        )
        counts = sorted((row["bin"], row["count"]) for row in bins.count().collect())
        for number, rows in counts:
            if wanted <= rows:
                low, high = low + number * step, min(high, low + (number + 1) * step)
                break
            wanted -= rows
    inside = drawn.filter((F.col("place") >= low) & (F.col("place") < high))
    if rows > wanted:
        inside = inside.orderBy("ticket", "id").limit(wanted)
    return drawn.filter(F.col("place") < low).unionByName(inside).select("id")
