"""Shared folder, lineage cuts, Arrow helpers and table readers for the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one where it is unset and Spark runs on this machine alone (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, with a short lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, *, release: bool = False) -> DataFrame:
    """The same rows, written as Parquet below the shared folder and read again; release: the shuffles that made them are deleted at once, not when the driver next collects its garbage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_RELEASE)
    try:
        if release:
            spark.conf.set(_RELEASE, "true")
        df.select("*").write.parquet(path)  # a frame of its own, made under the setting
    finally:
        spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of at most ``rows``, so that what is made of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies fn to each non-empty batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if (out := fn(batch)) is not None:
                yield out

    return run


class Memory(dict):
    """A dict that makes missing values, in two generations: when the newer one holds ``most`` entries it becomes the older one, and what is still used moves up again."""

    def __init__(self, make: Callable[[str | bytes], Any], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str | bytes) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            self[key] = value
        return value

    def turn(self) -> None:
        """Called between texts, so that no text's values go while it is put together."""
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()
