"""Materialised steps of iterative jobs.

A loop of joins must cut its lineage. Every step is written as a parquet table below the shared
folder the session names in ``spark.checkpoint.dir``: it survives lost executors, and reading it back
gives the optimizer true sizes, so a small delta is broadcast and a large one is shuffled.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-semgraph-")
    return _local_roots[app]


#: Rows of a table that may be sent to every executor by way of the driver.
FEW = 10_000
#: Shuffles of a query go as soon as it is done; otherwise they lie on disk until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files. What they read again must be a table, not a shuffle."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables of one job, each under its own name in a folder no other job uses.

    Files are many times smaller than their rows, so by file size alone a join would send large tables through the
    driver, in every round. With ``few`` tables of at most so many rows are broadcast, larger ones are joined by sorting,
    unless saved without ``hint`` and joined to a table that is hashed.
    """

    def __init__(self, spark: SparkSession, job: str, few: int | None = None) -> None:
        self.spark, self.few = spark, few
        self.folder = f"{scratch_root(spark)}/{job}-{uuid.uuid4().hex}"
        self._step = 0
        self._paths: dict[str, list[str]] = {}

    def save(self, df: DataFrame, name: str = "step", sort: tuple[str, ...] = (), hint: bool = True) -> DataFrame:
        self._step += 1
        path = f"{self.folder}/{self._step:04d}-{name}"
        out = df.sortWithinPartitions(*sort) if sort else df
        seen, hint = Observation(), hint and self.few is not None
        if hint:
            out = out.observe(seen, F.count(F.lit(1)).alias("n"))
        with tidy(self.spark):
            out.write.parquet(path)
        self._paths.setdefault(name, []).append(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        if not hint:
            return saved
        return saved.hint("broadcast" if seen.get["n"] <= self.few else "merge")

    def measured(self, df: DataFrame, name: str, *, hint: bool = True, **measures: Column) -> tuple[DataFrame, dict]:
        """Save a step and report aggregates of it (``n`` counts rows), taken while it is written.

        A loop learns whether to stop from the write itself instead of reading the step again.
        """
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()])
        return self.save(counted, name, hint=hint), seen.get

    def forget(self, *names: str, keep: int = 0) -> None:
        """Delete all but the last ``keep`` tables saved under these names; nothing may read them any more."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in names:
            paths = self._paths.get(name, [])
            for _ in range(len(paths) - keep):
                path = jvm.org.apache.hadoop.fs.Path(paths.pop(0))
                path.getFileSystem(conf).delete(path, True)
