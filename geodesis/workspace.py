"""Tables in the shared folder that cut the lineage of iterative jobs.

Every round of a traversal is written as a parquet table and read back, so a
lost executor costs one round at most and no plan grows with the number of
rounds. The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"

_local_base: str | None = None
_roots: list[str] = []


def _forget_local_base(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only in local mode."""
    global _local_base
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="geodesis-")
        atexit.register(_forget_local_base, _local_base)
    return _local_base


@contextmanager
def session_conf(spark: SparkSession, **settings: str):
    """Set SQL options (dots written as ``__``) for one block, then restore."""
    names = {key.replace("__", "."): value for key, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class Workspace:
    """One run's own folder below the shared one, holding named tables. A folder
    with a ``name`` is found again by later processes."""

    def __init__(self, spark: SparkSession, label: str = "run", name: str | None = None) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/geodesis-{label}-{name or uuid.uuid4().hex}"
        _roots.append(self.root)
        self._schemas: dict[str, T.StructType] = {}
        self._parts: dict[str, list[int]] = {}
        self._rows: dict[tuple[str, int | None], int] = {}
        self._filed: dict[str, str] = {}
        self._lent: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, frame: DataFrame, **metrics) -> dict:
        """Write ``frame`` as table ``name``; returns its row count as ``rows``
        and any further aggregates asked for, all observed in the same job."""
        seen = self._write(self.path(name), name, frame, metrics)
        self._rows[name, None] = seen["rows"]
        return seen

    def has(self, name: str) -> bool:
        return name in self._schemas

    def lend(self, name: str, frame: DataFrame) -> None:
        """Give ``frame`` out as table ``name`` as long as no such table is written."""
        self._lent[name] = frame

    def rows(self, name: str, part: int | None = None) -> int:
        """Row count seen when the table, or that part of it, was written."""
        return self._rows[name, part]

    def append(self, name: str, part: int, frame: DataFrame, again: bool = False) -> int:
        """Write ``frame`` as numbered part of table ``name``; returns the row count.
        ``again`` takes the place of a part that was not written to its end."""
        mode = "overwrite" if again else "error"
        rows = self._write(f"{self.path(name)}/part={part}", name, frame, {}, mode=mode)["rows"]
        self._parts.setdefault(name, []).append(part)
        self._rows[name, part] = rows
        self._rows[name, None] = self._rows.get((name, None), 0) + rows
        return rows

    def adopt(self, name: str, part: int) -> bool:
        """Whether an earlier process wrote that part to its end; it then counts as
        one of this table."""
        path = f"{self.path(name)}/part={part}"
        if not self._exists(f"{path}/_SUCCESS"):
            return False
        if part not in self._parts.setdefault(name, []):
            self._schemas[name] = self.spark.read.parquet(path).schema
            self._parts[name].append(part)
        return True

    def save_parted(self, name: str, frame: DataFrame, column: str) -> int:
        """Write ``frame`` with the values of integer ``column`` as part
        numbers, which follow each other; returns the highest (-1 if none)."""
        seen = self._write(
            self.path(name),
            name,
            frame.withColumnRenamed(column, "part"),
            {"low": F.min("part"), "high": F.max("part")},
            "part",
        )
        self._rows[name, None] = seen["rows"]
        fields = [field for field in self._schemas[name].fields if field.name != "part"]
        self._schemas[name] = T.StructType(fields)
        if not seen["rows"]:
            self._parts[name] = []
            return -1
        self._parts[name] = list(range(seen["low"], seen["high"] + 1))
        counts = self.parts(name).groupBy("part").count().collect()
        self._rows |= {(name, number): 0 for number in self._parts[name]}
        self._rows |= {(name, row["part"]): row["count"] for row in counts}
        return seen["high"]

    def file(self, name: str, frame: DataFrame, by: str) -> None:
        """Add rows to table ``name``, which has one folder per value of the
        integer column ``by`` however often rows are added."""
        frame.repartition(by, *[column for column in frame.columns if column != by]).write.mode("append").partitionBy(by).parquet(self.path(name))
        self._schemas[name] = T.StructType([field for field in frame.schema.fields if field.name != by])
        self._filed[name] = by

    def filed(self, name: str, value: int | None = None) -> DataFrame:
        """Rows filed under a value, or all; only that folder is listed."""
        path = self.path(name) if value is None else f"{self.path(name)}/{self._filed[name]}={value}"
        if not self._exists(path):
            return self.spark.createDataFrame([], self._schemas[name])
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _write(self, path: str, name: str, frame: DataFrame, metrics: dict, by: str | None = None, mode: str = "error") -> dict:
        observed = Observation()
        wanted = [F.count(F.lit(1)).alias("rows")]
        wanted += [column.alias(alias) for alias, column in metrics.items()]
        writer = frame.observe(observed, *wanted).write.mode(mode)
        (writer.partitionBy(by) if by else writer).parquet(path)
        self._schemas[name] = frame.schema
        return observed.get

    def load(self, name: str) -> DataFrame:
        if name in self._lent and not self.has(name):
            return self._lent[name]
        return self.spark.read.schema(self._schemas[name]).parquet(self.path(name))

    def parts(self, name: str, numbers: Iterable[int] | None = None) -> DataFrame:
        """Parts of a table (all by default) with their number as ``part``;
        only the folders of these parts are listed and read."""
        chosen = self._parts[name] if numbers is None else [n for n in numbers if n in self._parts[name]]
        schema = T.StructType(self._schemas[name].fields + [T.StructField("part", T.IntegerType())])
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return (
            self.spark.read.schema(schema)
            .option("basePath", self.path(name))
            .parquet(*[f"{self.path(name)}/part={number}" for number in chosen])
        )

    def drop(self, *names: str) -> None:
        """Delete tables of this run that no result reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))
            self._schemas.pop(name, None)
            self._parts.pop(name, None)
            self._filed.pop(name, None)
            self._lent.pop(name, None)
            for key in [key for key in self._rows if key[0] == name]:
                del self._rows[key]

    def discard(self) -> None:
        """Delete the whole folder of this run once nothing reads it any more."""
        _delete(self.spark, self.root)
        if self.root in _roots:
            _roots.remove(self.root)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_tables(spark: SparkSession) -> None:
    """Delete the tables of all calls made so far in this process, also of
    failed ones. DataFrames they returned can no longer be read."""
    while _roots:
        _delete(spark, _roots.pop())
