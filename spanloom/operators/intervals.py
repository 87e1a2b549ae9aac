"""Ordered-interval operators over segments (stream_id, idx, start_s, end_s, text) and match members.

Members are matches in long form: (stream_id, match_ord, title, confidence, idx).
Everything is keyed by stream, so one shuffle on stream_id serves a whole chain.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.folds import scan

MATCH = ["stream_id", "match_ord"]


def timed(members: DataFrame, segments: DataFrame) -> DataFrame:
    """Index to time look-up: members with start_s, end_s and text; indices outside the stream drop out."""
    return members.join(segments, ["stream_id", "idx"])


def split_at_gaps(members: DataFrame, segments: DataFrame, gap_s: float) -> DataFrame:
    """Members with times and part, the number of gaps longer than gap_s before them in their match."""
    order = Window.partitionBy(*MATCH).orderBy("idx")
    gap = F.col("start_s") - F.lag("end_s").over(order)
    rows = timed(members, segments).withColumn("cut", F.when(gap > gap_s, 1).otherwise(0))
    return rows.withColumn("part", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("cut")


def hulls(parts: DataFrame) -> DataFrame:
    """One row for each part: its index hull, times, text and confidence."""
    return parts.groupBy(*MATCH, "part").agg(
        F.first("title").alias("title"), F.first("confidence").alias("confidence"), F.min("idx").alias("lo"), F.max("idx").alias("hi"),
        F.min(F.struct("idx", "start_s"))["start_s"].alias("start_s"), F.max(F.struct("idx", "end_s"))["end_s"].alias("end_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("transcript"),
    )


def index_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of consecutive idx by keys: (keys, lo, hi, n)."""
    order = Window.partitionBy(*keys).orderBy("idx")
    runs = rows.select(*keys, "idx").distinct().withColumn("run", F.col("idx") - F.row_number().over(order))
    return runs.groupBy(*keys, "run").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n")).drop("run")


def uncovered(segments: DataFrame, members: DataFrame, least: int = 1) -> DataFrame:
    """Maximal index ranges that no match covers, of at least ``least`` segments."""
    free = segments.select("stream_id", "idx").join(members.select("stream_id", "idx"), ["stream_id", "idx"], "left_anti")
    return index_ranges(free, ["stream_id"]).where(F.col("n") >= least)


def chunked(ranges: DataFrame, size: int) -> DataFrame:
    """Ranges cut into pieces of at most size segments: (keys, lo, hi)."""
    kept = [c for c in ranges.columns if c not in ("lo", "hi", "n")]
    cut = ranges.withColumn("at", F.explode(F.sequence("lo", "hi", F.lit(max(1, size)).cast("long"))))
    return cut.select(*kept, F.col("at").alias("lo"), F.least(F.col("hi"), F.col("at") + size - 1).alias("hi"))


def range_seconds(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """Ranges with seconds, from the start of their first to the end of their last segment, 0 at least."""
    first = segments.select("stream_id", F.col("idx").alias("lo"), F.col("start_s").alias("from_s"))
    last = segments.select("stream_id", F.col("idx").alias("hi"), F.col("end_s").alias("to_s"))
    return ranges.join(first, ["stream_id", "lo"]).join(last, ["stream_id", "hi"]).withColumn("seconds", F.greatest(F.lit(0.0), F.col("to_s") - F.col("from_s"))).drop("from_s", "to_s")


def packed(ranges: DataFrame, span: int, most: int | None = None) -> DataFrame:
    """Ordered ranges put into windows: a window takes the next range while it spans at most ``span`` segments and, if given, ``most`` units (column n). A fold that carries the open window on."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        window, begin, units = -1, 0, 0
        for lo, hi, n in rows:
            if window >= 0 and hi - begin + 1 <= span and (most is None or units + n <= most):
                units += n
            else:
                window, begin, units = window + 1, lo, n
            yield lo, hi, window

    unit = F.col("n") if most is not None else F.lit(1)
    return scan(ranges.select("stream_id", "lo", "hi", unit.cast("long").alias("n")), ["stream_id"], ["lo", "hi", "n"], fold, "lo long, hi long, window long")


def expanded(ranges: DataFrame, segments: DataFrame, context: int) -> DataFrame:
    """Ranges widened by context segments on both sides, inside their stream."""
    size = segments.groupBy("stream_id").agg(F.max("idx").alias("top"))
    return ranges.join(size, "stream_id").withColumn("lo", F.greatest(F.lit(0).cast("long"), F.col("lo") - context)).withColumn("hi", F.least("top", F.col("hi") + context)).drop("top")


def overlap_pairs(members: DataFrame) -> DataFrame:
    """Pairs of matches that share segments: (stream_id, a, b, shared), a before b. Equi-join on the segment, never on the stream alone."""
    a = members.select("stream_id", "idx", F.col("match_ord").alias("a"))
    b = members.select("stream_id", "idx", F.col("match_ord").alias("b"))
    return a.join(b, ["stream_id", "idx"]).where("a < b").groupBy("stream_id", "a", "b").agg(F.count("*").alias("shared"))


def numbered(ranges: DataFrame, letter: str) -> DataFrame:
    """Ids such as P001 by range order within a stream."""
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy("lo", "hi"))
    return ranges.withColumn("id", F.format_string(f"{letter}%03d", n))


def cover_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """By stream: segments covered by both, only by left, only by right."""
    a, b = (x.select("stream_id", "idx").distinct().withColumn(c, F.lit(1)) for x, c in ((left, "l"), (right, "r")))
    both = a.join(b, ["stream_id", "idx"], "full")
    return both.groupBy("stream_id").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))
