"""Input tables of the queries, derived from the given tables by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.sources.checkpoints import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each user, a segment for each event: (stream_id, idx, start_s, end_s, text)."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "stream_id")
    order = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return events.select(
        "stream_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), start.alias("start_s"), (start + F.col("value")).alias("end_s"), F.col("event_type").alias("text")
    )


def members(spark: SparkSession, sf_dir: str, segs: DataFrame | None = None) -> DataFrame:
    """Matches in long form: (stream_id, match_ord, title, confidence, idx), of segs where these are at hand.

    A match for each stream, text and day; every seventh segment also brings its
    successor, so that matches of different titles overlap.
    """
    segs = (segments(spark, sf_dir) if segs is None else segs).withColumn("day", F.floor(F.col("start_s") / 86400).cast("long"))
    size = F.count("*").over(Window.partitionBy("stream_id"))
    own = segs.withColumn("n", size).select("stream_id", "text", "day", "n", F.explode(F.when(F.col("idx") % 7 == 0, F.array("idx", F.col("idx") + 1)).otherwise(F.array("idx"))).alias("idx"))
    rows = own.where(F.col("idx") < F.col("n")).select("stream_id", F.col("text").alias("title"), "day", "idx").distinct()
    heads = rows.groupBy("stream_id", "title", "day").agg(F.min("idx").alias("lo"), F.sum("idx").alias("s"))
    heads = heads.withColumn("match_ord", (F.row_number().over(Window.partitionBy("stream_id").orderBy("lo", "title", "day")) - 1).cast("long"))
    heads = heads.select("stream_id", "title", "day", "match_ord", ((F.col("s") * 7 + F.col("day")) % 100 / F.lit(100.0)).alias("confidence"))
    return rows.join(heads, ["stream_id", "title", "day"]).select("stream_id", "match_ord", "title", "confidence", "idx")


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(members, segments), read and made once and dealt by stream (eager actions)."""
    segs = dealt(segments(spark, sf_dir))
    return dealt(members(spark, sf_dir, segs)), segs


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each conversation, a segment for each turn, ten characters a second."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    chars = F.sum(F.length("text")).over(order)
    return turns.select(
        F.col("conv_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), ((chars - F.length("text")) / F.lit(10.0)).alias("start_s"), (chars / F.lit(10.0)).alias("end_s"), "text"
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counters of calls: (stream_id, phase, content_type, hit, miss, completion)."""
    phase = F.create_map(*(F.lit(x) for p in PHASES.items() for x in p))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("stream_id"), F.coalesce(F.element_at(phase, F.concat("l_returnflag", "l_linestatus")), F.lit("main")).alias("phase"),
        F.when(F.col("l_linenumber") % 2 == 0, "song").otherwise("dialogue").alias("content_type"),
        F.col("l_quantity").cast("long").alias("hit"), F.col("l_linenumber").cast("long").alias("miss"), F.floor(F.col("l_extendedprice") / 1000).cast("long").alias("completion"),
    )


PHASES = {"AF": "main", "NF": "review", "NO": "missed_recheck", "RF": "overlong_recheck"}

#: The same tables as common table expressions.
SQL = {
    "segments": """segments AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  epoch_us(ts) / 1e6::DOUBLE AS start_s, epoch_us(ts) / 1e6::DOUBLE + value AS end_s, event_type AS text FROM events)""",
    "members": """m_day AS (SELECT *, floor(start_s / 86400)::BIGINT AS day, count(*) OVER (PARTITION BY stream_id) AS n FROM segments),
m_own AS (SELECT stream_id, text AS title, day, n, unnest(CASE WHEN idx % 7 = 0 THEN [idx, idx + 1] ELSE [idx] END) AS idx FROM m_day),
m_rows AS (SELECT DISTINCT stream_id, title, day, idx FROM m_own WHERE idx < n),
m_heads AS (SELECT stream_id, title, day, min(idx) AS lo, sum(idx)::BIGINT AS s FROM m_rows GROUP BY ALL),
m_ord AS (SELECT stream_id, title, day, row_number() OVER (PARTITION BY stream_id ORDER BY lo, title, day) - 1 AS match_ord, ((s * 7 + day) % 100) / 100.0::DOUBLE AS confidence FROM m_heads),
members AS (SELECT stream_id, match_ord, title, confidence, idx FROM m_rows JOIN m_ord USING (stream_id, title, day))""",
    "transcripts": """t_turns AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY ALL),
t_chars AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS chars FROM t_turns),
transcripts AS (SELECT conv_id AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, (chars - length(text)) / 10.0::DOUBLE AS start_s, chars / 10.0::DOUBLE AS end_s, text FROM t_chars)""",
    "usage": """usage AS (SELECT l_suppkey AS stream_id, CASE l_returnflag || l_linestatus WHEN 'NF' THEN 'review' WHEN 'NO' THEN 'missed_recheck' WHEN 'RF' THEN 'overlong_recheck' ELSE 'main' END AS phase,
  CASE WHEN l_linenumber % 2 = 0 THEN 'song' ELSE 'dialogue' END AS content_type, l_quantity::BIGINT AS hit, l_linenumber::BIGINT AS miss, floor(l_extendedprice / 1000)::BIGINT AS completion FROM lineitem)""",
}


def with_inputs(*names: str, body: str, more: str = "") -> str:
    """A query over the named inputs, with further expressions after them."""
    parts = [SQL[n] for n in names] + ([more] if more else [])
    return f"WITH RECURSIVE {', '.join(parts)} {body}"
