"""Clip intervals from matches: gap split, capped merge, padding against neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from spanloom.operators.folds import scan
from spanloom.operators.intervals import hulls, split_at_gaps


@dataclass(frozen=True)
class Padding:
    """Seconds; a cap of 0 or less is none. Song types respect neighbouring segments, others only the stream."""

    before: float = 15.0
    after: float = 15.0
    guard: float = 2.0
    shortest: float = 75.0
    cap: float = 360.0
    gap: float = 40.0
    adaptive: bool = True
    threshold: float = 25.0
    ratio: float = 0.95
    before_max: float = 45.0
    after_max: float = 45.0
    song: bool = True


PART = "start_s double, match_ord long, part long, end_s double, lo long, hi long, title string, confidence double, transcript string"


def merge_adjacent(parts: DataFrame, gap_s: float, cap_s: float) -> DataFrame:
    """Merges a part into the one before it, in order of start, if their index hulls overlap, or titles are equal and at most gap_s lies between, unless the result is longer than cap_s.

    The rule depends on what was merged before, so it is a fold, which carries the
    last part on; texts are joined once, when a part is done.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, said = None, []
        for row in rows:
            start, match_ord, part, end, lo, hi, title, confidence, text = row
            if last is not None:
                overlap = lo <= last[5] and hi >= last[4]
                same = start - last[3] <= gap_s and title is not None and title == last[6]
                if (overlap or same) and (cap_s <= 0 or max(last[3], end) - min(last[0], start) <= cap_s):
                    longer = title if len(title or "") > len(last[6] or "") else last[6]
                    last = (*last[:3], max(last[3], end), min(last[4], lo), max(last[5], hi), longer, max(last[7], confidence))
                    said.append(text)
                    continue
                yield (*last, " ".join(said))
            last, said = row[:8], [text]
        if last is not None:
            yield (*last, " ".join(said))

    fields = [f.name for f in StructType.fromDDL(PART)]
    return scan(parts.select("stream_id", *fields), ["stream_id"], ["start_s", "match_ord", "part"], fold, PART)


def silence_padding(base: float, gap: Column, most: float, p: Padding) -> Column:
    """Padding that grows with the silence beside a clip."""
    if base <= 0 or not p.adaptive:
        return F.lit(base)
    gap = F.greatest(F.lit(0.0), gap)
    wide = F.greatest(F.lit(base), F.least(F.lit(max(base, most)), gap * min(1.0, max(0.0, p.ratio))))
    return F.when(gap <= p.threshold, F.lit(base)).otherwise(wide)


def build_clips(segments: DataFrame, members: DataFrame, p: Padding) -> DataFrame:
    """Clips (stream_id, clip_index, title, start_s, end_s, duration_s, confidence, transcript); numbers count clips dropped for shortness."""
    merged = merge_adjacent(hulls(split_at_gaps(members, segments, p.gap)), p.gap, p.cap)
    order = Window.partitionBy("stream_id").orderBy("start_s", "match_ord", "part")
    merged = merged.withColumn("clip_index", F.row_number().over(order).cast("long"))
    total = segments.groupBy("stream_id").agg(F.max("end_s").alias("total"))
    rows = merged.join(total, "stream_id")
    if p.song:
        before = segments.select("stream_id", (F.col("idx") + 1).alias("lo"), F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"))
        after = segments.select("stream_id", (F.col("idx") - 1).alias("hi"), F.col("start_s").alias("a_start"), F.col("end_s").alias("a_end"))
        rows = rows.join(before, ["stream_id", "lo"], "left").join(after, ["stream_id", "hi"], "left")
        low = F.coalesce(F.col("b_start") + p.guard, F.lit(0.0))
        high = F.coalesce(F.greatest(F.col("end_s"), F.col("a_end") - p.guard), F.col("total"))
        pad_b = silence_padding(p.before, F.col("start_s") - F.coalesce("b_end", F.lit(0.0)), p.before_max, p)
        pad_a = silence_padding(p.after, F.coalesce("a_start", "total") - F.col("end_s"), p.after_max, p)
        start = F.least(F.col("start_s"), F.greatest(low, F.col("start_s") - pad_b))
        end = F.greatest(F.col("end_s"), F.least(high, F.col("end_s") + pad_a))
    else:
        start, end = F.col("start_s") - p.before, F.col("end_s") + p.after
    rows = rows.select("stream_id", "clip_index", "title", F.greatest(F.lit(0.0), start).alias("start_s"), F.least(F.col("total"), end).alias("end_s"), "confidence", "transcript")
    return rows.withColumn("duration_s", F.col("end_s") - F.col("start_s")).where(F.col("duration_s") >= p.shortest)
