"""Consistency, duration and recovery rules over the parts of a recording.

Parts are (folder, part_idx, duration_s, codec, width, height, fps, probe_ok).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHAPE = ("codec", "width", "height", "fps")


def consistency(parts: DataFrame) -> DataFrame:
    """By folder: whether all parts are probed and alike (the least and the greatest value of a column are one, so that no row is multiplied), their expected duration, and the target shape (that of the smallest picture, with the lowest rate)."""
    alike = F.lit(True)
    for c in SHAPE:
        value = F.coalesce(F.col(c).cast("string"), F.lit("-"))
        alike = alike & (F.min(value) == F.max(value))
    least = F.min(F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct((F.col("width") * F.col("height")).alias("area"), "part_idx", "width", "height")))
    return parts.groupBy("folder").agg(
        F.count("*").alias("parts"), (F.bool_and("probe_ok") & alike).alias("direct_copy"), F.when(F.count_if(F.col("duration_s").isNull()) == 0, F.sum("duration_s")).alias("expected_s"),
        least["width"].alias("target_width"), least["height"].alias("target_height"), F.min(F.round("fps", 3)).alias("target_fps"),
    )


def conformance(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """Parts with conforms: whether they have their folder's target shape."""
    same = (F.col("width") == F.col("target_width")) & (F.col("height") == F.col("target_height")) & (F.abs(F.col("fps") - F.col("target_fps")) < 0.01)
    return parts.join(targets.select("folder", "target_width", "target_height", "target_fps"), "folder").select("folder", "part_idx", F.coalesce(same, F.lit(False)).alias("conforms"))


def corrupt_share(parts: DataFrame, corrupt: DataFrame) -> DataFrame:
    """By folder: corrupt seconds and their share of all; null if a duration is unknown. corrupt is (folder, part_idx)."""
    rows = parts.join(corrupt.select("folder", "part_idx").distinct().withColumn("bad", F.lit(True)), ["folder", "part_idx"], "left")
    out = rows.groupBy("folder").agg(F.count_if(F.col("duration_s").isNull()).alias("unknown"), F.sum(F.when(F.col("bad"), F.col("duration_s")).otherwise(0.0)).alias("bad_s"), F.sum("duration_s").alias("all_s"), F.count_if("bad").alias("bad_parts"), F.count("*").alias("parts"))
    known = F.col("unknown") == 0
    return out.select("folder", F.when(known, F.col("bad_s")).alias("bad_s"), F.when(known, F.try_divide(F.col("bad_s"), F.col("all_s"))).alias("bad_share"), "bad_parts", "parts")


def recovery(parts: DataFrame, corrupt: DataFrame) -> DataFrame:
    """By folder the first strategy that applies: copy, repair (a corrupt share of at most a half, by seconds or else by parts), normalise."""
    c = consistency(parts)
    s = corrupt_share(parts, corrupt).select("folder", "bad_share", "bad_parts")
    odd = conformance(parts, c).groupBy("folder").agg(F.count_if(~F.col("conforms")).alias("odd_parts"))
    rows = c.join(s, "folder").join(odd, "folder")
    share = F.coalesce("bad_share", F.col("bad_parts") / F.col("parts"))
    name = F.when(F.col("direct_copy") & (F.col("bad_parts") == 0), "direct_copy").when((F.col("bad_parts") > 0) & (share <= 0.5), "targeted_repair").otherwise("normalise")
    return rows.select("folder", "direct_copy", "bad_parts", "odd_parts", name.alias("strategy"))


def duration_ok(checks: DataFrame) -> DataFrame:
    """(folder, expected_s, actual_s) with ok: within max(30 s, 0.5 %)."""
    return checks.withColumn("ok", F.abs(F.col("actual_s") - F.col("expected_s")) <= F.greatest(F.lit(30.0), F.col("expected_s") * 0.005))


def boundary_parts(parts: DataFrame, observed: DataFrame) -> DataFrame:
    """Parts around the point where a joined output stopped: the first part whose running duration is within max(2 s, 0.05 %) of the observed one, and its neighbours."""
    order = Window.partitionBy("folder").orderBy("part_idx")
    every = Window.partitionBy("folder")
    run = parts.withColumn("run", F.sum("duration_s").over(order)).withColumn("total", F.sum("duration_s").over(every))
    run = run.withColumn("unknown", F.count_if(F.col("duration_s").isNull()).over(order)).join(observed, "folder").where("observed_s > 0 and unknown = 0")
    hit = run.where(F.abs(F.col("run") - F.col("observed_s")) <= F.greatest(F.lit(2.0), F.col("total") * 0.0005)).groupBy("folder").agg(F.min("part_idx").alias("at"))
    return parts.join(hit, "folder").where(F.abs(F.col("part_idx") - F.col("at")) <= 1).select("folder", "part_idx")


def scan_plan(parts: DataFrame, *, supported: tuple[str, ...] = ("h264", "hevc"), short_s: float = 120.0) -> DataFrame:
    """Parts with scan: full if short, else tail; none for other codecs."""
    scan = F.when(~F.col("codec").isin(*supported) | F.col("codec").isNull(), "none").when(F.col("duration_s") < short_s, "full").otherwise("tail")
    return parts.select("folder", "part_idx", scan.alias("scan"))
