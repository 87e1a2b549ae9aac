"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in spark.checkpoint.dir (a new folder where that is unset and Spark runs on this machine alone, as in tests)."""
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def by_stream(df: DataFrame) -> DataFrame:
    """The rows of df, kept and dealt by stream_id: what groups or orders such tables by stream and more moves no row again."""
    return cut(df).repartition("stream_id")


#: Settings under which Spark knows how kept rows are dealt, and joins rows that lie together by some of the keys without moving them.
_AS_DEALT = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def dealt(df: DataFrame, key: str = "stream_id") -> DataFrame:
    """The rows of df, dealt by key and kept so (an eager action). What joins, groups or orders such tables by key and more, and is kept this way again, moves no row.

    The settings that this takes hold while df is planned and kept, no longer.
    """
    spark = df.sparkSession
    before = {name: spark.conf.get(name) for name in _AS_DEALT}
    try:
        for name, value in _AS_DEALT.items():
            spark.conf.set(name, value)
        return cut(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The rows of df, kept (an eager action), and joined by broadcast if there are at most ``most``: a few common keys then bring no crowd of rows to one task."""
    kept = cut(df)
    return F.broadcast(kept) if len(kept.select(F.lit(1)).take(most + 1)) <= most else kept
