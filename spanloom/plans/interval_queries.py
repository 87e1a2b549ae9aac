"""Queries of the interval and clip operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import clips, intervals as iv
from spanloom.plans.inputs import members, segments, with_inputs

GAP = 86400.0
PAD = clips.Padding(before=900.0, after=900.0, guard=60.0, shortest=3000.0, cap=360_000.0, gap=GAP, threshold=1500.0, ratio=0.5, before_max=7200.0, after_max=7200.0)
PLAIN = clips.Padding(before=900.0, after=900.0, shortest=3000.0, cap=360_000.0, gap=GAP, song=False)

_PARTS = f"""timed AS (SELECT * FROM members JOIN segments USING (stream_id, idx)),
cuts AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER w > {GAP} THEN 1 ELSE 0 END AS cut FROM timed WINDOW w AS (PARTITION BY stream_id, match_ord ORDER BY idx)),
parts AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, match_ord ORDER BY idx)::BIGINT AS part FROM cuts),
hulls AS (SELECT stream_id, match_ord, part, any_value(title) AS title, any_value(confidence) AS confidence, min(idx) AS lo, max(idx) AS hi, arg_min(start_s, idx) AS start_s, arg_max(end_s, idx) AS end_s, string_agg(text, ' ' ORDER BY idx) AS transcript FROM parts GROUP BY ALL)"""

_MERGED = (
    _PARTS
    + f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_s, match_ord, part) AS k FROM hulls),
fold AS (
  SELECT stream_id, k, start_s, match_ord, part, end_s, lo, hi, title, confidence, transcript, 1::BIGINT AS out FROM ordered WHERE k = 1
  UNION ALL
  SELECT x.stream_id, x.k,
    CASE WHEN j THEN f.start_s ELSE x.start_s END, CASE WHEN j THEN f.match_ord ELSE x.match_ord END, CASE WHEN j THEN f.part ELSE x.part END,
    CASE WHEN j THEN greatest(f.end_s, x.end_s) ELSE x.end_s END, CASE WHEN j THEN least(f.lo, x.lo) ELSE x.lo END, CASE WHEN j THEN greatest(f.hi, x.hi) ELSE x.hi END,
    CASE WHEN j AND length(x.title) <= length(f.title) THEN f.title ELSE x.title END, CASE WHEN j THEN greatest(f.confidence, x.confidence) ELSE x.confidence END,
    CASE WHEN j THEN f.transcript || ' ' || x.transcript ELSE x.transcript END, CASE WHEN j THEN f.out ELSE f.out + 1 END
  FROM fold f JOIN ordered x ON x.stream_id = f.stream_id AND x.k = f.k + 1,
  LATERAL (SELECT ((x.lo <= f.hi AND x.hi >= f.lo) OR (x.start_s - f.end_s <= {GAP} AND x.title = f.title)) AND greatest(f.end_s, x.end_s) - least(f.start_s, x.start_s) <= {PAD.cap} AS j)
),
merged AS (SELECT stream_id, out AS clip_index, arg_max(start_s, k) AS start_s, arg_max(end_s, k) AS end_s, arg_max(lo, k) AS lo, arg_max(hi, k) AS hi, arg_max(title, k) AS title, arg_max(confidence, k) AS confidence, arg_max(transcript, k) AS transcript FROM fold GROUP BY ALL),
total AS (SELECT stream_id, max(end_s) AS total FROM segments GROUP BY ALL)"""
)


def _pad_sql(base: float, gap: str, most: float) -> str:
    return f"CASE WHEN greatest(0, {gap}) <= {PAD.threshold} THEN {base} ELSE greatest({base}, least({most}, greatest(0, {gap}) * {PAD.ratio}::DOUBLE)) END"


_CLIPS = f"""padded AS (SELECT m.stream_id, clip_index, m.title, m.confidence, m.transcript, total,
  least(m.start_s, greatest(coalesce(b.start_s + {PAD.guard}, 0), m.start_s - ({_pad_sql(PAD.before, "m.start_s - coalesce(b.end_s, 0)", PAD.before_max)}))) AS s,
  greatest(m.end_s, least(coalesce(greatest(m.end_s, a.end_s - {PAD.guard}), total), m.end_s + ({_pad_sql(PAD.after, "coalesce(a.start_s, total) - m.end_s", PAD.after_max)}))) AS e
  FROM merged m JOIN total USING (stream_id) LEFT JOIN segments b ON b.stream_id = m.stream_id AND b.idx = m.lo - 1 LEFT JOIN segments a ON a.stream_id = m.stream_id AND a.idx = m.hi + 1)"""
_CLIP_ROWS = "SELECT stream_id, clip_index, title, greatest(0, s) AS start_s, least(total, e) AS end_s, confidence, transcript, least(total, e) - greatest(0, s) AS duration_s FROM {} WHERE least(total, e) - greatest(0, s) >= 3000"


def q_clips(spark, d):
    return clips.build_clips(segments(spark, d), members(spark, d), PAD)


def q_clips_plain(spark, d):
    return clips.build_clips(segments(spark, d), members(spark, d), PLAIN)


def q_gap_split(spark, d):
    return iv.hulls(iv.split_at_gaps(members(spark, d), segments(spark, d), GAP)).drop("transcript")


def q_capped_merge(spark, d):
    parts = iv.hulls(iv.split_at_gaps(members(spark, d), segments(spark, d), GAP))
    return clips.merge_adjacent(parts, GAP, PAD.cap).select("stream_id", "start_s", "end_s", "lo", "hi", "title", "confidence", "transcript")


def _rare(spark, d):
    """Members of two titles only, so that much stays uncovered."""
    return members(spark, d).where(F.col("title").isin("click", "purchase"))


_RARE = "rare AS (SELECT * FROM members WHERE title IN ('click', 'purchase'))"
_FREE = (
    _RARE
    + """, free AS (SELECT stream_id, idx FROM segments ANTI JOIN rare USING (stream_id, idx)),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS run FROM free),
gaps AS (SELECT stream_id, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM runs GROUP BY stream_id, run),
long AS (SELECT * FROM gaps WHERE n >= 2)"""
)


def q_uncovered(spark, d):
    return iv.uncovered(segments(spark, d), _rare(spark, d), 2)


def q_index_ranges(spark, d):
    return iv.index_ranges(members(spark, d), ["stream_id", "match_ord"])


def q_chunks(spark, d):
    return iv.chunked(q_uncovered(spark, d), 3)


def q_long_targets(spark, d):
    """Uncovered chunks of at least an hour, numbered: the targets of a recheck."""
    timed = iv.range_seconds(q_chunks(spark, d), segments(spark, d)).where("seconds >= 3600")
    return iv.numbered(timed, "U").select("stream_id", "lo", "hi", "seconds", "id")


def q_short_ranges_dropped(spark, d):
    timed = iv.range_seconds(q_chunks(spark, d), segments(spark, d))
    return timed.groupBy("stream_id").agg(F.count_if(F.col("seconds") >= 3600).alias("kept"), F.count_if(F.col("seconds") < 3600).alias("dropped"))


def q_windows(spark, d):
    return iv.packed(iv.uncovered(segments(spark, d), _rare(spark, d), 1), 20)


def q_windows_counted(spark, d):
    return iv.packed(iv.uncovered(segments(spark, d), _rare(spark, d), 1), 30, 8)


def q_context(spark, d):
    return iv.expanded(q_uncovered(spark, d), segments(spark, d), 2)


def q_overlaps(spark, d):
    return iv.overlap_pairs(members(spark, d))


def q_hull_overlaps(spark, d):
    """Pairs of matches whose index hulls meet, each hull dealt to the blocks of 16 segments it touches."""
    hull = members(spark, d).groupBy("stream_id", "match_ord").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    dealt = hull.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / 16), F.floor(F.col("hi") / 16))))
    a = dealt.select("stream_id", "block", F.col("match_ord").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = dealt.select("stream_id", "block", F.col("match_ord").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    met = a.join(b, ["stream_id", "block"]).where("a < b and alo <= bhi and blo <= ahi")
    return met.where(F.col("block") == F.floor(F.greatest("alo", "blo") / 16)).select("stream_id", "a", "b", (F.least("ahi", "bhi") - F.greatest("alo", "blo") + 1).alias("hull_shared"))


def q_cover_compare(spark, d):
    m = members(spark, d)
    return iv.cover_compare(m.where("confidence >= 0.5"), m.where("confidence < 0.7"))


def q_order_by_first(spark, d):
    from pyspark.sql.window import Window

    hull = members(spark, d).groupBy("stream_id", "match_ord").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return hull.withColumn("rank", F.row_number().over(Window.partitionBy("stream_id").orderBy("lo", "match_ord")).cast("long"))


def q_match_context(spark, d):
    """Every match with the two segments on either side of each of its own, and which are its own."""
    m, s = members(spark, d), segments(spark, d)
    near = m.withColumn("around", F.explode(F.sequence(F.lit(-2).cast("long"), F.lit(2).cast("long"))))
    near = near.select("stream_id", "match_ord", (F.col("idx") + F.col("around")).alias("idx"), (F.col("around") == 0).alias("own"))
    return near.join(s, ["stream_id", "idx"]).groupBy("stream_id", "match_ord", "idx").agg(F.bool_or("own").alias("is_match"), F.first("text").alias("text"))


QUERIES = {
    "c3_build_clips_song": q_clips, "c3_build_clips_plain": q_clips_plain, "w1_gap_split": q_gap_split, "c1_capped_merge": q_capped_merge, "w2_uncovered_ranges": q_uncovered,
    "f11_index_ranges": q_index_ranges, "w3_chunk_ranges": q_chunks, "w7_p6_numbered_targets": q_long_targets, "p6_short_ranges": q_short_ranges_dropped, "w4_window_packing": q_windows,
    "w5_cluster_packing": q_windows_counted, "j4_context": q_context, "j2_overlap_pairs": q_overlaps, "j3_hull_overlaps": q_hull_overlaps, "u4_cover_compare": q_cover_compare,
    "l1_order_by_first": q_order_by_first, "k2_match_context": q_match_context,
}

_E, _M = ("segments", "members"), ("members",)


def _packed_sql(span: int, most: int | None) -> str:
    fits = f"x.hi - f.begin + 1 <= {span}" + (f" AND f.n + x.n <= {most}" if most else "")
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY lo, hi) AS k FROM gaps),
pack AS (SELECT stream_id, k, lo, hi, n, lo AS begin, 0::BIGINT AS "window" FROM ranked WHERE k = 1 UNION ALL
SELECT x.stream_id, x.k, x.lo, x.hi, CASE WHEN {fits} THEN f.n + x.n ELSE x.n END, CASE WHEN {fits} THEN f.begin ELSE x.lo END, CASE WHEN {fits} THEN f."window" ELSE f."window" + 1 END
FROM pack f JOIN ranked x ON x.stream_id = f.stream_id AND x.k = f.k + 1)"""


_CHUNKS = _FREE + ", chunks AS (SELECT stream_id, c AS lo, least(hi, c + 2) AS hi FROM (SELECT *, unnest(range(lo, hi + 1, 3)) AS c FROM long))"
_TIMED = _CHUNKS + ", secs AS (SELECT c.stream_id, c.lo, c.hi, greatest(0, l.end_s - f.start_s) AS seconds FROM chunks c JOIN segments f ON f.stream_id = c.stream_id AND f.idx = c.lo JOIN segments l ON l.stream_id = c.stream_id AND l.idx = c.hi)"
_HULL = "hull AS (SELECT stream_id, match_ord, min(idx) AS lo, max(idx) AS hi FROM members GROUP BY ALL)"

SQL = {
    "c3_build_clips_song": with_inputs(*_E, more=_MERGED + ", " + _CLIPS, body=_CLIP_ROWS.format("padded")),
    "c3_build_clips_plain": with_inputs(*_E, more=_MERGED + ", plain AS (SELECT m.*, total, m.start_s - 900 AS s, m.end_s + 900 AS e FROM merged m JOIN total USING (stream_id))", body=_CLIP_ROWS.format("plain")),
    "w1_gap_split": with_inputs(*_E, more=_PARTS, body="SELECT stream_id, match_ord, part, title, confidence, lo, hi, start_s, end_s FROM hulls"),
    "c1_capped_merge": with_inputs(*_E, more=_MERGED, body="SELECT stream_id, start_s, end_s, lo, hi, title, confidence, transcript FROM merged"),
    "w2_uncovered_ranges": with_inputs(*_E, more=_FREE, body="SELECT * FROM long"),
    "f11_index_ranges": with_inputs(*_E, more="runs AS (SELECT stream_id, match_ord, idx, idx - row_number() OVER (PARTITION BY stream_id, match_ord ORDER BY idx) AS run FROM members)", body="SELECT stream_id, match_ord, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM runs GROUP BY stream_id, match_ord, run"),
    "w3_chunk_ranges": with_inputs(*_E, more=_CHUNKS, body="SELECT * FROM chunks"),
    "w7_p6_numbered_targets": with_inputs(*_E, more=_TIMED, body="SELECT stream_id, lo, hi, seconds, printf('U%03d', row_number() OVER (PARTITION BY stream_id ORDER BY lo, hi)) AS id FROM secs WHERE seconds >= 3600"),
    "p6_short_ranges": with_inputs(*_E, more=_TIMED, body="SELECT stream_id, count(*) FILTER (seconds >= 3600) AS kept, count(*) FILTER (seconds < 3600) AS dropped FROM secs GROUP BY ALL"),
    "w4_window_packing": with_inputs(*_E, more=_FREE + _packed_sql(20, None), body='SELECT stream_id, lo, hi, "window" FROM pack'),
    "w5_cluster_packing": with_inputs(*_E, more=_FREE + _packed_sql(30, 8), body='SELECT stream_id, lo, hi, "window" FROM pack'),
    "j4_context": with_inputs(*_E, more=_FREE + ", top AS (SELECT stream_id, max(idx) AS top FROM segments GROUP BY ALL)", body="SELECT stream_id, greatest(0, lo - 2) AS lo, least(top, hi + 2) AS hi, n FROM long JOIN top USING (stream_id)"),
    "j2_overlap_pairs": with_inputs(*_E, body="SELECT a.stream_id, a.match_ord AS a, b.match_ord AS b, count(*) AS shared FROM members a JOIN members b ON a.stream_id = b.stream_id AND a.idx = b.idx AND a.match_ord < b.match_ord GROUP BY ALL"),
    "j3_hull_overlaps": with_inputs(*_E, more=_HULL, body="SELECT a.stream_id, a.match_ord AS a, b.match_ord AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 AS hull_shared FROM hull a JOIN hull b ON a.stream_id = b.stream_id AND a.match_ord < b.match_ord AND a.lo <= b.hi AND b.lo <= a.hi"),
    "u4_cover_compare": with_inputs(*_E, more="l AS (SELECT DISTINCT stream_id, idx, 1 AS l FROM members WHERE confidence >= 0.5), r AS (SELECT DISTINCT stream_id, idx, 1 AS r FROM members WHERE confidence < 0.7)", body="SELECT stream_id, count(*) FILTER (l = 1 AND r = 1) AS both, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right FROM l FULL JOIN r USING (stream_id, idx) GROUP BY ALL"),
    "l1_order_by_first": with_inputs(*_E, more=_HULL, body="SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY lo, match_ord) AS rank FROM hull"),
    "k2_match_context": with_inputs(*_E, more="near AS (SELECT stream_id, match_ord, idx + a AS idx, a = 0 AS own FROM members, (SELECT unnest([-2, -1, 0, 1, 2]) AS a))", body="SELECT stream_id, match_ord, idx, bool_or(own) AS is_match, any_value(text) AS text FROM near JOIN segments USING (stream_id, idx) GROUP BY ALL"),
}
