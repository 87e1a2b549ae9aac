"""Queries that ask an annotator: two content types at once, and the older four-stage run; their annotators answer by rule, so that SQL can tell the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spanloom.operators import annotate as an, legacy as lg, matches as mt, stages as st
from spanloom.plans import match_queries as mq, stage_queries as sq
from spanloom.plans.inputs import both, segments, with_inputs
from spanloom.sources.checkpoints import cut

GAP, CAP = mq.GAP, mq.SOFT_MAX
_E = ("segments", "members")


def _item(title, *indices):
    """A JSON object of a title and indices."""
    return F.concat(F.lit('{"title": "'), title, F.lit('", "confidence": "0.8", "segment_indices": ['), F.concat_ws(", ", *indices), F.lit("]}"))


def two_items(requests):
    """Two matches for each request; the text is plain, cut off, fenced or no answer by turns."""
    one = _item(F.concat("content_type", F.lit(" a")), "lo", "hi")
    two = _item(F.concat("content_type", F.lit(" b")), F.least(F.col("lo") + 1, "hi"))
    text, k = F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]")), (F.col("stream_id") + F.col("request")) % 4
    raw = F.when(k == 0, text).when(k == 1, F.expr("left(t, length(t) - 5)")).when(k == 2, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise("none")
    return requests.withColumn("t", text).select(*an.REQUEST, raw.alias("raw"))


TYPES = an.ContentTypes(
    an.ContentType("song", "Name the songs.", 8, compose=lambda m, s: st.normalise(m, s, gap_s=GAP, cap_s=CAP)[0]),
    an.ContentType("dialogue", "Name the dialogues.", 5, compose=lambda m, s: mt.drop_duplicates(m)),
    an.ContentType("unused"),
)


def q_types(spark, d):
    found = an.annotated(cut(segments(spark, d)), TYPES.enabled({"content_types": ["song", "dialogue"]}), two_items)
    return found.groupBy("content_type", "stream_id", "match_ord").agg(F.first("title").alias("title"), F.first("confidence").alias("confidence"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))


RULES = lg.Rules(gap_s=GAP, cap_s=CAP, span=12, nearby=0, context=1, chunk=6, pack=12, least_s=10.0, kind=an.ContentType("song", "Go over these."))


def by_turns(requests):
    """Answers of every kind, by stream, place and phase: none, unreadable, empty, good, conflicting, still too long."""
    k, lo, hi, phase = (F.col("stream_id") + F.col("lo")) % 5, F.col("lo"), F.col("hi"), F.col("phase")
    a, b = lo + F.floor((hi - lo) / 4), lo + F.floor((hi - lo) / 2)
    three = _item(F.when(k == 2, "click").when(k == 3, "view").otherwise("purchase"), a, a + 1, b)
    review = F.when(k == 0, "sorry").when(k == 1, "[]").when(k == 4, F.concat(F.lit("["), three, F.lit(", "), _item(F.lit("cart"), a), F.lit("]"))).otherwise(F.concat(F.lit("["), three, F.lit("]")))
    every = F.array_join(F.transform(F.sequence(lo, hi), lambda x: x.cast("string")), ", ")
    long = F.when(k <= 2, F.concat(F.lit("["), _item(F.lit("click"), lo, lo + 1), F.lit(", "), _item(F.lit("click"), hi), F.lit("]"))).when(k == 3, F.concat(F.lit("["), _item(F.lit("view"), every), F.lit("]")))
    missed = F.when(k <= 3, F.concat(F.lit("["), _item(F.lit("purchase"), lo, lo + 1, hi), F.lit("]")))
    raw = F.when(phase == "overlong", long).when(phase == "missed", missed).otherwise(review)
    return requests.select(*an.REQUEST, raw.alias("raw")).where("raw is not null")


def _legacy(spark, d):
    every, segs = both(spark, d)
    return lg.legacy_run(every.where("title <> 'purchase'"), segs, by_turns, RULES, searched=sq._searched(spark))


def q_legacy(spark, d):
    return mt.heads(_legacy(spark, d).members)


QUERIES = {"annotate_types": q_types, "v11_legacy_run": q_legacy}


def _as(prefix: str, text: str, names: str) -> str:
    """The text with its expressions' names prefixed, so that it can stand several times in one query."""
    return re.sub(rf"\b({names.replace(' ', '|')})\b", lambda m: prefix + m.group(1), text)


def _norm(p: str, source: str) -> str:
    return _as(p, sq._norm(CAP, source), "n_t n_c n_p n_k n_n n_r n_s n_f norm flag") + f", {p}nm AS (SELECT stream_id, match_ord, title, confidence, idx FROM {p}norm)"


def _settled(p: str, source: str, suspicious: str, near: bool) -> str:
    text = sq._adjudicated(source, suspicious)
    if near:
        text = text.replace("+ 1 <= 12)),", "+ 1 <= 12)" + mq._NEAR + "),", 1)
    return _as(p, text, "h share edges both_ways start reach clusters times sets ranked greedy won")


def _review(p: str, source: str) -> str:
    """Expressions of a review of source, the last one {p}out."""
    sus = "EXISTS (SELECT 1 FROM " + p + "su s0 WHERE s0.stream_id = {0}.stream_id AND s0.match_ord = {0}.match_ord)"
    return f"""{_norm(p, source)}, {p}su AS (SELECT stream_id, match_ord FROM {p}flag WHERE split OR long), {_settled(p, p + 'nm', sus, True)},
{p}hd AS ({mq._HEADS.format(p + 'nm')}), {p}rg AS (SELECT stream_id, cluster, min(lo) AS clo, max(hi) AS chi, count(*) AS own, bool_or(title NOT LIKE '未知歌曲%') AS named FROM {p}hd JOIN {p}clusters USING (stream_id, match_ord) GROUP BY ALL),
{p}rq AS (SELECT stream_id, cluster, greatest(0, clo - 1) AS lo, least(t, chi + 1) AS hi, (stream_id + greatest(0, clo - 1)) % 5 AS k FROM {p}rg JOIN tops USING (stream_id) WHERE chi - clo + 1 <= 12),
{p}an AS (SELECT stream_id, cluster, 0 AS pos, CASE k WHEN 2 THEN 'click' WHEN 3 THEN 'view' ELSE 'purchase' END AS title, unnest(list_distinct([lo + (hi - lo) // 4, lo + (hi - lo) // 4 + 1, lo + (hi - lo) // 2])) AS idx, lo, hi FROM {p}rq WHERE k >= 2 UNION ALL SELECT stream_id, cluster, 1, 'cart', lo + (hi - lo) // 4, lo, hi FROM {p}rq WHERE k = 4),
{p}vd AS (SELECT g.stream_id, g.cluster, q.k IS NOT NULL AND k IN (2, 3) AS taken, CASE WHEN k IN (2, 3) THEN 1 < own WHEN k = 4 THEN 2 < own ELSE false END AS whole FROM {p}rg g LEFT JOIN {p}rq q ON q.stream_id = g.stream_id AND q.cluster = g.cluster),
{p}gd AS (SELECT a.stream_id, a.cluster, pos, title, a.idx, whole, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY a.stream_id, a.cluster, pos ORDER BY a.idx) > {GAP} THEN 1 ELSE 0 END AS cut FROM {p}an a JOIN {p}vd v ON v.stream_id = a.stream_id AND v.cluster = a.cluster AND taken JOIN segments g ON g.stream_id = a.stream_id AND g.idx = a.idx WHERE a.idx BETWEEN lo AND hi),
{p}sp AS (SELECT *, CASE WHEN whole THEN 0 ELSE sum(cut) OVER (PARTITION BY stream_id, cluster, pos ORDER BY idx) END AS part FROM {p}gd),
{p}ev AS (SELECT stream_id, title, confidence, idx, 0 AS kind, 0::BIGINT AS c, match_ord AS a, 0::BIGINT AS b FROM {p}nm ANTI JOIN {p}clusters USING (stream_id, match_ord)
  UNION ALL SELECT m.stream_id, m.title, m.confidence, idx, 1, g.cluster, lo, m.match_ord FROM {p}nm m JOIN {p}greedy g ON g.stream_id = m.stream_id AND g.match_ord = m.match_ord AND keep JOIN {p}vd v ON v.stream_id = g.stream_id AND v.cluster = g.cluster AND NOT taken JOIN {p}hd hd ON hd.stream_id = m.stream_id AND hd.match_ord = m.match_ord
  UNION ALL SELECT stream_id, title, 0.8::DOUBLE, idx, 1, cluster, pos, part::BIGINT FROM {p}sp),
{p}ls AS (SELECT stream_id, dense_rank() OVER (PARTITION BY stream_id ORDER BY kind, c, a, b) - 1 AS match_ord, title, confidence, idx FROM {p}ev),
{_norm(p + 'f', p + 'ls')}, {_settled(p + 'f', p + 'fnm', 'false', False)}, {p}out AS (SELECT stream_id, match_ord, title, confidence, idx FROM {p}fwon)"""


_LONG = f"""o_t AS (SELECT m.*, start_s, end_s, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) > {GAP} THEN 1 ELSE 0 END AS cut FROM r1out m JOIN segments USING (stream_id, idx)),
o_p AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, match_ord ORDER BY idx)::BIGINT AS part FROM o_t), o_l AS (SELECT stream_id, match_ord, part, min(idx) AS lo, max(idx) AS hi FROM o_p GROUP BY ALL HAVING arg_max(end_s, idx) - arg_min(start_s, idx) > {CAP}),
o_q AS (SELECT *, greatest(0, lo - 1) AS xlo, least(t, hi + 1) AS xhi, (stream_id + greatest(0, lo - 1)) % 5 AS k FROM o_l JOIN tops USING (stream_id)),
o_a AS (SELECT stream_id, match_ord, part, lo, hi, 0 AS pos, unnest([xlo, xlo + 1]) AS idx FROM o_q WHERE k <= 2 UNION ALL SELECT stream_id, match_ord, part, lo, hi, 1, xhi FROM o_q WHERE k <= 2), o_g AS (SELECT * FROM o_a WHERE idx BETWEEN lo AND hi), o_r AS (SELECT DISTINCT stream_id, match_ord, part FROM o_g), o_m AS (SELECT DISTINCT stream_id, match_ord FROM o_l),
o_e AS (SELECT stream_id, title, confidence, idx, match_ord AS a, 0::BIGINT AS part, 0 AS b FROM r1out ANTI JOIN o_m USING (stream_id, match_ord)
  UNION ALL SELECT stream_id, title, confidence, idx, match_ord, part, 0 FROM o_p SEMI JOIN o_m USING (stream_id, match_ord) ANTI JOIN o_r USING (stream_id, match_ord, part) UNION ALL SELECT stream_id, 'click', 0.8::DOUBLE, idx, match_ord, part, pos FROM o_g),
longs AS (SELECT stream_id, dense_rank() OVER (PARTITION BY stream_id ORDER BY a, part, b) - 1 AS match_ord, title, confidence, idx FROM o_e)"""
_MISSED = """u_f AS (SELECT stream_id, idx FROM segments ANTI JOIN longs USING (stream_id, idx)), u_r AS (SELECT *, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS run FROM u_f), u_g AS (SELECT stream_id, min(idx) AS lo, max(idx) AS hi FROM u_r GROUP BY stream_id, run),
u_c AS (SELECT stream_id, c AS lo, least(hi, c + 5) AS hi FROM (SELECT *, unnest(range(lo, hi + 1, 6)) AS c FROM u_g)),
u_t AS (SELECT c.stream_id, c.lo, c.hi, row_number() OVER (PARTITION BY c.stream_id ORDER BY c.lo, c.hi) AS k FROM u_c c JOIN segments f ON f.stream_id = c.stream_id AND f.idx = c.lo JOIN segments l ON l.stream_id = c.stream_id AND l.idx = c.hi WHERE greatest(0, l.end_s - f.start_s) >= 10),
u_p AS (SELECT stream_id, k, lo, hi, lo AS begin, 0::BIGINT AS w FROM u_t WHERE k = 1 UNION ALL SELECT x.stream_id, x.k, x.lo, x.hi, CASE WHEN x.hi - f.begin + 1 <= 12 THEN f.begin ELSE x.lo END, CASE WHEN x.hi - f.begin + 1 <= 12 THEN f.w ELSE f.w + 1 END FROM u_p f JOIN u_t x ON x.stream_id = f.stream_id AND x.k = f.k + 1),
u_w AS (SELECT stream_id, w, greatest(0, min(lo) - 1) AS lo, max(hi) + 1 AS h FROM u_p GROUP BY ALL), u_q AS (SELECT stream_id, w, lo, least(t, h) AS hi, row_number() OVER (PARTITION BY stream_id ORDER BY w) - 1 AS n FROM u_w JOIN tops USING (stream_id) WHERE (stream_id + lo) % 5 <= 3),
u_a AS (SELECT DISTINCT stream_id, n, unnest([lo, lo + 1, hi]) AS idx, hi FROM u_q), u_x AS (SELECT a.* FROM u_a a SEMI JOIN u_t t ON t.stream_id = a.stream_id AND a.idx BETWEEN t.lo AND t.hi WHERE a.idx <= a.hi), u_s AS (SELECT stream_id, max(match_ord) + 1 AS s FROM longs GROUP BY ALL),
u_l AS (SELECT * FROM longs UNION ALL SELECT stream_id, n + coalesce(s, 0), 'purchase', 0.8::DOUBLE, idx FROM u_x LEFT JOIN u_s USING (stream_id))"""
_MERGED = _as("u", mq._merge_sql(False).replace("FROM members", "FROM unm").replace("JOIN members", "JOIN unm"), "heads ends changes runs past cuts parts grp merged")
_TYPES = """tq AS (SELECT 'song' AS content_type, stream_id, idx // 8 AS request, min(idx) AS lo, max(idx) AS hi FROM segments GROUP BY ALL UNION ALL SELECT 'dialogue', stream_id, idx // 5, min(idx), max(idx) FROM segments GROUP BY ALL),
ti AS (SELECT content_type, stream_id, request, 0 AS pos, content_type || ' a' AS title, list_distinct([lo, hi]) AS ids FROM tq WHERE (stream_id + request) % 4 <> 3 UNION ALL SELECT content_type, stream_id, request, 1, content_type || ' b', [least(lo + 1, hi)] FROM tq WHERE (stream_id + request) % 4 IN (0, 2)),
tn AS (SELECT content_type, stream_id, title, unnest(ids) AS idx, match_ord, 0.8::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY content_type, stream_id ORDER BY request, pos) - 1 AS match_ord FROM ti)), songs AS (SELECT stream_id, match_ord, title, confidence, idx FROM tn WHERE content_type = 'song')"""

SQL = {
    "annotate_types": with_inputs(*_E, more=f"{_TYPES}, {_norm('t', 'songs')}", body="""SELECT content_type, stream_id, match_ord, any_value(title) AS title, any_value(confidence) AS confidence, min(idx) AS lo, max(idx) AS hi, count(*) AS n
FROM (SELECT 'song' AS content_type, stream_id, match_ord, title, confidence, idx FROM tnm UNION ALL SELECT content_type, stream_id, match_ord, title, confidence, idx FROM tn WHERE content_type = 'dialogue') GROUP BY content_type, stream_id, match_ord"""),
    "v11_legacy_run": with_inputs(*_E, more=f"tops AS (SELECT stream_id, max(idx) AS t FROM segments GROUP BY ALL), lone AS (SELECT * FROM members WHERE title <> 'purchase'), {_review('r1', 'lone')}, {_LONG}, {_MISSED}, {_norm('u', 'u_l')}, {_MERGED}, {_review('r2', 'umerged')}", body=mq._HEADS.format("r2out")),
}
