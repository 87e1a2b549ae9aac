"""Reports and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.scalars import preview_timecode, timecode


def clip_report(clips: DataFrame) -> DataFrame:
    """Clips with timecodes, as their report shows them."""
    return clips.select("stream_id", "clip_index", "title", timecode(F.col("start_s")).alias("start"), timecode(F.col("end_s")).alias("end"), F.bround("duration_s", 3).alias("duration_s"), "confidence", "transcript")


def write_clips(clips: DataFrame, path: str, partition: str = "stream_id") -> None:
    clip_report(clips).write.partitionBy(partition).json(f"{path}/json")
    clip_report(clips).write.partitionBy(partition).option("header", "true").csv(f"{path}/csv")


def preview(clips: DataFrame, most: int = 5) -> DataFrame:
    """The first clips of each stream, one line each, and how many more there are."""
    order, every = Window.partitionBy("stream_id").orderBy("clip_index"), Window.partitionBy("stream_id")
    rows = clips.withColumn("k", F.row_number().over(order)).withColumn("more", F.greatest(F.lit(0), F.count("*").over(every) - most))
    line = F.concat_ws(" ", preview_timecode(F.col("start_s")), F.lit("-"), preview_timecode(F.col("end_s")), "title")
    return rows.where(F.col("k") <= most).select("stream_id", F.col("k").cast("long").alias("k"), line.alias("line"), "more")


def risk_audit(risks: DataFrame) -> DataFrame:
    """By stream: records, those to review, and the reasons that occur."""
    reasons = F.sort_array(F.array_distinct(F.flatten(F.collect_list("reasons"))))
    return risks.groupBy("stream_id").agg(F.count("*").alias("records"), F.count_if(F.col("action") != "accept").alias("to_review"), F.array_join(reasons, ",").alias("reasons"))


def manifest(clips: DataFrame, usage: DataFrame) -> DataFrame:
    """By stream: clips, their seconds, and calls."""
    a = clips.groupBy("stream_id").agg(F.count("*").alias("clips"), F.sum(F.round(F.col("duration_s") * 1000).cast("long")).alias("clip_ms"))
    b = usage.groupBy("stream_id").agg(F.count("*").alias("calls"))
    return a.join(b, "stream_id", "full").fillna(0)


def comparison_markdown(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: a Markdown table of a small report, ordered by its key."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", key, *columns), F.lit(" |"))
    head = "| " + " | ".join([key, *columns]) + " |\n|" + "---|" * (len(columns) + 1)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.agg(F.concat(F.lit(head + "\n"), body).alias("markdown"))


def pending(inputs: DataFrame, state: DataFrame, key: str = "stream_id") -> DataFrame:
    """Inputs without a success in the state table (key, status); failures come again."""
    return inputs.join(state.where("status = 'success'").select(key), key, "left_anti")


def upserted(state: DataFrame, new: DataFrame, key: str = "stream_id") -> DataFrame:
    """The state table with new rows in place of those of their keys."""
    return state.join(new.select(key), key, "left_anti").unionByName(new)


def export_plan(clips: DataFrame, *, copy_codecs: tuple[str, ...] = ("h264", "hevc")) -> DataFrame:
    """(stream_id, clip_index, file, copy) of clips with codec and extension: the name to cut to, and whether the codec can be copied."""
    name = F.concat(F.format_string("%03d", "clip_index"), F.lit("-"), F.translate(F.col("title"), '<>:"/\\|?*', "_" * 9), F.lit("."), F.col("extension"))
    return clips.select("stream_id", "clip_index", name.alias("file"), F.col("codec").isin(*copy_codecs).alias("copy"))


def summary_markdown(levels: DataFrame) -> DataFrame:
    """(stream_id, markdown) of (stream_id, ord, level, heading, body): headings by level, in order."""
    line = F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), "heading", F.when(F.coalesce("body", F.lit("")) != "", F.concat(F.lit("\n"), "body")).otherwise(""))
    return levels.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("markdown"))
