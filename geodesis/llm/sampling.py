"""Bounded samples that come out the same however rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How many times as many hashes as are wanted are looked at.
SPARE = 4


def lowest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the lowest hash of integer column
    ``key``. Hashes above a share that surely holds enough are left out where
    they are read, so only a few times ``most`` rows ever meet."""
    size = rows.agg(F.approx_count_distinct(key)).first()[0]
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    if size > SPARE * most:
        hashed = hashed.filter(F.col("_hash") / 2.0**64 + 0.5 < SPARE * most / size)
    return hashed.orderBy("_hash", key).limit(most).drop("_hash")
