"""Exact search for the largest inner products.

Components become whole numbers, so scores are exact. Queries are dealt into
groups and candidates into chunks; a cell of the grid holds one group and runs
through one chunk by descending length, in blocks. A block is left out for a
query if the product of lengths cannot reach the query's bar, its k-th score so
far. For the rest the first rotated components are multiplied, and the lengths
of what remains bound the rest (Cauchy-Schwarz); pairs that may still reach the
bar are scored in full. The rotation comes from the singular vectors of a bounded
sample, which only decides how well the bounds prune. The first bars come from
the longest candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geodesis.llm.sampling import lowest_hashes
from geodesis.workspace import Workspace

# Whole numbers are exact in doubles up to here.
EXACT = 1 << 52
# Stands for a score that no long can hold, and is refused if it is to be returned.
BEYOND = (1 << 63) - 1


@dataclass(frozen=True)
class Sizes:
    """Sizes of the grid; results do not depend on them."""

    sample: int = 4096
    """Vectors the rotation is fitted on."""
    heads: int = 1024
    """Longest candidates that give the first bars; sent to every task."""
    group: int = 65_536
    """Queries of a group."""
    chunk: int = 8_192
    """Candidates of a chunk, unless that makes more than ``chunks``."""
    chunks: int = 512
    block: int = 1024
    """Candidates of a block."""


# Queries that a block is held against at once: 32 MB of bounds with a full block.
ASKED = 4096


def _codes(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """Ids and whole-number vectors of the rows that take part."""
    for key, vector in zip(batch.column("vec_id").to_pylist(), batch.column("vector")):
        if key is None or not vector.is_valid or vector.values.null_count:
            continue
        values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(values).all():
            whole = np.floor(scale * values)
            if not np.isfinite(whole).all():
                raise ValueError(f"a component of vector {key} is too large for a double once it is scaled")
            yield key, whole


def whole_vectors(vectors: DataFrame, scale: int, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, code, length``: components as doubles with whole values, and
    the length of the vector."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_codes(batch, scale))
            yield pa.record_batch(
                [
                    pa.array([key for key, _ in rows], pa.int64()),
                    pa.array([x.astype("<f8").tobytes() for _, x in rows], pa.binary()),
                    pa.array([float(_lengths(x[None, :])[0]) for _, x in rows], pa.float64()),
                ],
                ["vec_id", "code", "length"],
            )

    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.mapInArrow(read, "vec_id long, code binary, length double")


def _matrix(codes: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    if all(len(code) == 8 * width for code in codes):
        return np.frombuffer(b"".join(codes), "<f8").reshape(len(codes), width)
    made = np.zeros((len(codes), width))
    for row, code in zip(made, codes):
        row[: len(code) // 8] = np.frombuffer(code, "<f8")
    return made


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares are beyond a double."""
    with np.errstate(over="ignore"):
        found = np.sqrt((vectors**2).sum(axis=1))
    for k in np.flatnonzero(~np.isfinite(found)):
        most = np.abs(vectors[k]).max()
        found[k] = min(most * np.sqrt(((vectors[k] / most) ** 2).sum()), np.finfo(float).max)
    return found


class Rotation:
    """Axes in the order of how much of the vectors lies along them."""

    def __init__(self, sample: np.ndarray) -> None:
        width = sample.shape[1]
        self.width = width
        most = np.abs(sample).max(initial=1.0)
        self.axes = np.linalg.svd(sample / most, full_matrices=len(sample) < width)[2].T if len(sample) else np.eye(width)
        self.front = max(1, width // 4) if width else 0

    def parts(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first rotated components, and the length of the rest."""
        turned = vectors @ self.axes
        return turned[:, : self.front], _lengths(turned[:, self.front :])


class Best:
    """The k best of every query so far, by score and then by smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: Rotation, bars: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.front, self.rest = rotation.parts(vectors)
        self.length = _lengths(vectors)
        self.rotation, self.bars = rotation, bars
        self.query = np.zeros(0, np.int64)
        self.found = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)

    def wanted(self, longest: float) -> np.ndarray:
        """Queries that a vector of that length may still matter to."""
        # A bound beyond a double, or none at all, leaves nothing out.
        with np.errstate(over="ignore", invalid="ignore"):
            return np.flatnonzero(~(self.length * longest * (1 + 1e-9) + 1e-6 < self.bars))

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> bool:
        """Take in a block; False if neither it nor shorter vectors matter."""
        lengths = _lengths(vectors)
        wanted = self.wanted(lengths.max())
        if not len(wanted):
            return False
        front, rest = self.rotation.parts(vectors)
        for at in range(0, len(wanted), ASKED):
            asked = wanted[at : at + ASKED]
            with np.errstate(over="ignore", invalid="ignore"):
                bound = self.front[asked] @ front.T + np.outer(self.rest[asked], rest)
                bound += 1e-9 * np.outer(self.length[asked], lengths) + 1e-6
            near = ~(bound < self.bars[asked, None]) & (self.ids[asked, None] != ids[None, :])
            q, x = np.nonzero(near)
            if len(q):
                q = asked[q]
                score = self._scores(q, x, vectors, lengths)
                good = score >= self.bars[q]
                self._merge(q[good], ids[x[good]], score[good])
        return True

    def _scores(self, q: np.ndarray, x: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        found = np.zeros(len(q), np.int64)
        if not self.vectors.shape[1]:
            return found
        with np.errstate(over="ignore"):
            exact = self.length[q] * lengths[x] < EXACT
        plain = np.flatnonzero(exact)
        for at in range(0, len(plain), 65536):
            k = plain[at : at + 65536]
            found[k] = np.einsum("ij,ij->i", self.vectors[q[k]], vectors[x[k]])
        # Doubles cannot hold these sums: whole numbers of any size do.
        for k in np.flatnonzero(~exact):
            score = sum(int(a) * int(b) for a, b in zip(self.vectors[q[k]].tolist(), vectors[x[k]].tolist()))
            found[k] = max(-BEYOND, min(BEYOND, score))
        return found

    def _merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        query, found = np.concatenate((self.query, q)), np.concatenate((self.found, ids))
        score = np.concatenate((self.score, score))
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        kept = place < self.k
        self.query, self.found, self.score = query[kept], found[kept], score[kept]
        last = place[kept] == self.k - 1
        at = self.query[last]
        self.bars[at] = np.maximum(self.bars[at], self.score[last])


def _first_bars(queries: DataFrame, heads: list, rotation: Rotation, k: int) -> DataFrame:
    """``queries`` with ``bar``: the k-th score among the longest candidates."""
    ids = np.array([row["vec_id"] for row in heads], np.int64)
    vectors = _matrix([bytes(row["code"]) for row in heads], rotation.width)

    def barred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own = batch.column("vec_id").to_numpy()
            best = Best(own, _matrix(batch.column("code").to_pylist(), rotation.width), rotation, np.full(len(own), -np.inf), k)
            for at in range(0, len(ids), 256):
                best.offer(ids[at : at + 256], vectors[at : at + 256])
            yield pa.record_batch([*batch.columns, pa.array(best.bars)], [*batch.schema.names, "bar"])

    return queries.mapInArrow(barred, "vec_id long, code binary, length double, bar double")


def _cells(rotation: Rotation, k: int, block: int):
    """Search the cells that arrive in one piece: queries first, then
    candidates by descending length."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, going = None, None, True
        held: list[tuple[list, list, list]] = []

        def results() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array(best.ids[best.query]), pa.array(best.found), pa.array(best.score)], ["query_id", "vec_id", "score"]
            )

        def started() -> Best:
            ids = np.array([x for part in held for x in part[0]], np.int64)
            vectors = _matrix([x for part in held for x in part[1]], rotation.width)
            return Best(ids, vectors, rotation, np.array([x for part in held for x in part[2]]), k)

        for batch in batches:
            for at, end, (group, chunk, kind) in _runs(batch):
                if cell != (group, chunk):
                    if best is not None:
                        yield results()
                    cell, best, going, held = (group, chunk), None, True, []
                part = batch.slice(at, end - at)
                ids, codes = part.column("vec_id").to_pylist(), part.column("code").to_pylist()
                if kind == 0:
                    held.append((ids, codes, part.column("bar").to_pylist()))
                    continue
                if best is None and held:
                    best, held = started(), []
                for low in range(0, len(ids), block) if best is not None and going else ():
                    going = best.offer(np.array(ids[low : low + block], np.int64), _matrix(codes[low : low + block], rotation.width))
                    if not going:
                        break
        if best is not None:
            yield results()

    return searched


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
    """Rows of a batch with the same group, chunk and kind."""
    if not len(batch):
        return
    keys = np.stack([batch.column(name).to_numpy() for name in ("group", "chunk", "kind")])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
        yield at, end, tuple(keys[:, at].tolist())


def largest_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``is_query`` (on
    column ``vec_id``) holds, the ``k`` other rows with the largest inner
    product of ``floor(scale * component)``; ties go to the smaller id.

    Rows without id, null vectors and vectors that hold a null or a number that
    is not finite take no part. Vectors of different lengths are compared as if
    filled up with zeros. Scores are exact whatever the size of components; a
    score to be returned that no long can hold fails, and so does a component
    that no double can hold once it is scaled. Rows with the query's id are its
    own; other repeated rows count as often as they occur, a repeated query once.
    An empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    tables = Workspace(spark, "topk")
    seen = tables.save("codes", whole_vectors(vectors, scale, vec_id, vector), width=F.max(F.octet_length("code")))
    codes = tables.load("codes")
    width = (seen["width"] or 0) // 8
    sample = lowest_hashes(codes, "vec_id", sizes.sample).select("code").collect()
    rotation = Rotation(_matrix([bytes(row["code"]) for row in sample], width))
    # About the longest; which ones they are only decides on the first bars.
    above = max(0.0, 1 - sizes.heads / max(1, seen["rows"]))
    long = codes.agg(F.percentile_approx("length", above)).first()[0]
    heads = codes.filter(F.col("length") >= (long or 0.0)).limit(sizes.heads).collect()
    heads.sort(key=lambda row: -row["length"])
    queries = codes.filter(is_query).groupBy("vec_id").agg(F.min_by("code", "code").alias("code"), F.first("length").alias("length"))
    asked = tables.save("queries", _first_bars(queries, heads, rotation, k), least=F.min(F.col("bar") / F.greatest("length", F.lit(1e-9))), low=F.min("bar"))
    groups = max(1, ceil(asked["rows"] / sizes.group))
    chunks = max(1, min(sizes.chunks, ceil(seen["rows"] / sizes.chunk)))
    # No query has use for candidates shorter than this.
    short = max(0.0, asked["least"] * (1 - 1e-6)) if asked["low"] is not None and asked["low"] > 0 else 0.0
    of = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = tables.load("queries").select(
        of("vec_id", groups).alias("group"), every(chunks).alias("chunk"), F.lit(0).alias("kind"), "vec_id", "code", "length", "bar"
    )
    right = codes.filter(F.col("length") >= short).select(
        every(groups).alias("group"), of("vec_id", chunks).alias("chunk"), F.lit(1).alias("kind"), "vec_id", "code", "length", F.lit(None).cast("double").alias("bar")
    )
    cells = left.unionByName(right).repartitionById(groups * chunks, F.col("group") * chunks + F.col("chunk"))
    ordered = cells.sortWithinPartitions("group", "chunk", "kind", F.desc("length"), "vec_id")
    found = ordered.mapInArrow(_cells(rotation, k, sizes.block), "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    score = F.when(F.col("score").isin(BEYOND, -BEYOND), F.raise_error(F.lit("a score is too large for a long"))).otherwise(F.col("score"))
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", score.cast("long").alias("score"))
