"""Queries of rechecks, anchor expansion and naming, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import coverage as cv, intervals as iv, matches as mt, naming as nm
from spanloom.plans.inputs import both, members, segments, table, with_inputs
from spanloom.sources.checkpoints import dealt

_E = ("segments", "members")
GAP, CAP = 86400.0, 30_000.0


def _rare(spark, d):
    return members(spark, d).where(F.col("title").isin("click", "purchase"))


def q_crop(spark, d):
    return mt.heads(cv.crop(members(spark, d), iv.uncovered(segments(spark, d), _rare(spark, d), 2)))


def q_overlong(spark, d):
    return cv.overlong_requests(members(spark, d), segments(spark, d), GAP, CAP, 3)


def q_replacements(spark, d):
    m = members(spark, d)
    new = m.where("match_ord % 5 <> 0 and (match_ord % 2 = 0 or idx % 3 = 0)")
    return cv.accept_replacements(m, new, segments(spark, d), GAP, CAP)


def q_recheck(spark, d):
    return cv.recheck_windows(segments(spark, d), _rare(spark, d), size=4, least_s=600.0, span=20, context=2)


def q_chorus(spark, d):
    parts = cv.split_by_chorus(members(spark, d), segments(spark, d), 43200.0, GAP, context=1)
    return parts.groupBy("stream_id", "match_ord", "part").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))


def q_contested(spark, d):
    """An anchor at every fourth free segment, in an order of their own: many to an island, where earlier ones claim first."""
    rows, segs = both(spark, d)
    held = rows.where("title = 'click'")
    free = dealt(iv.uncovered(segs, held, 1))
    anchors = free.select("stream_id", F.explode(F.sequence("lo", "hi")).alias("idx")).where("idx % 4 = 0").select("stream_id", (F.col("idx") * 7919 % 10007).alias("match_ord"), "idx")
    grown = dealt(cv.expand_anchors(anchors, free, held, segs, gap_s=1e12, cap_s=1e12))
    return grown.groupBy("stream_id", "match_ord").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))


def q_boundary_events(spark, d):
    return cv.boundary_events(members(spark, d), segments(spark, d), 10_000.0)


def q_anchors(spark, d):
    """One anchor for each uncovered range, grown inside it."""
    free = iv.uncovered(segments(spark, d), _rare(spark, d), 1)
    anchors = free.select("stream_id", F.col("lo").alias("match_ord"), F.floor((F.col("lo") + F.col("hi")) / 2).alias("idx"))
    grown = cv.expand_anchors(anchors, free, _rare(spark, d), segments(spark, d), gap_s=1e12, cap_s=CAP)
    return grown.groupBy("stream_id", "match_ord").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))


def q_review_guard(spark, d):
    m = members(spark, d)
    return cv.review_guard(m, m.where("match_ord <> 2 or stream_id % 3 <> 0").where("stream_id % 11 <> 0"), segments(spark, d), span=14)


def _paths(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "supplier"), F.col("o_custkey") % 50 == F.col("s_suppkey"))
    texts = F.array(F.concat(F.lit("live "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(F.col("o_orderkey") % 3 == 0, F.lit("none")).otherwise(F.lower("s_name")), F.concat(F.lit("x"), F.col("s_name")))
    return o.select(F.col("o_orderkey").alias("key"), texts.alias("texts"))


def q_streamers(spark, d):
    dictionary = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("entry_ord"), F.concat(F.lit("S"), "s_suppkey").alias("streamer"), F.lit(0).alias("alias_ord"), F.col("s_name").alias("alias"))
    return nm.resolve_streamers(_paths(spark, d), dictionary, ratio=False)  # SQL has no sequence ratio; the next query has, and tests hold it against a plain version


def q_streamers_ratio(spark, d):
    """The same by likeness of whole names, from misspelt ones."""
    o = _paths(spark, d).withColumn("texts", F.transform("texts", lambda t: F.regexp_replace(t, "supplier", "suplier")))
    dictionary = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("entry_ord"), F.concat(F.lit("S"), "s_suppkey").alias("streamer"), F.lit(0).alias("alias_ord"), F.col("s_name").alias("alias"))
    return nm.resolve_streamers(o, dictionary)


def _search(spark, d):
    b = table(spark, d, "benchmark")
    q = b.select(F.col("item_id").alias("key"), F.col("text").alias("query"))
    r = b.select("item_id", "text").select(F.explode(F.array("item_id", F.col("item_id") + 1, F.col("item_id") + 2)).alias("key"), "text", "item_id")
    return q, r.select("key", (F.col("key") - F.col("item_id") + 1).alias("rank"), F.concat(F.lit("T"), "item_id").alias("title"), F.when(F.col("item_id") % 4 == 0, F.lit("zzz qqq")).otherwise(F.col("text")).alias("snippet"))


def q_query_texts(spark, d):
    m = members(spark, d)
    k = F.col("match_ord")
    h = mt.heads(m).select("stream_id", "match_ord", F.when(k % 3 == 0, F.col("title")).alias("snippet"), F.when(k % 3 == 1, F.concat(F.lit("[严重程度:3/5][场景:A]  song "), k)).alias("description"))
    return nm.query_texts(h, m, segments(spark, d))


def q_evidence(spark, d):
    return nm.search_evidence(*_search(spark, d))


def q_verify(spark, d):
    q, r = _search(spark, d)
    m = q.select("key", F.when(F.col("key") % 2 == 0, "未知歌曲：x").otherwise("own").alias("title"))
    return nm.verify_titles(m, nm.search_evidence(q, r))


def q_supported(spark, d):
    q, r = _search(spark, d)
    m = q.select("key", F.when(F.col("key") % 3 == 0, F.concat(F.lit("t"), "key")).otherwise(F.lit("missing")).alias("title"), F.lit("").alias("artist"))
    return nm.title_in_results(m, r)


def q_recover(spark, d):
    s = table(spark, d, "supplier")
    titles = s.select((F.col("s_suppkey") % 5).alias("folder"), F.col("s_suppkey").alias("index"), F.concat(F.lpad("s_suppkey", 4, "0"), F.lit(" name")).alias("title"))
    stem = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.col("s_suppkey"), F.lit("-�"))).otherwise(F.concat(F.lit("x"), F.lpad("s_suppkey", 4, "0"), F.lit("�")))
    return nm.recover_titles(s.where("s_suppkey % 7 <> 0").select((F.col("s_suppkey") % 5).alias("folder"), stem.alias("stem")), titles, by_place=True)


def q_renames(spark, d):
    s = table(spark, d, "customer")
    return nm.rename_plan(s.select((F.col("c_custkey") % 10).alias("folder"), F.lpad("c_custkey", 6, "0").alias("stem"), F.lit("S").alias("streamer"), F.concat(F.lit("t"), F.col("c_custkey") % 7).alias("title"), F.lit("").alias("artist"), F.lit("260603").alias("date")))


QUERIES = {
    "c9_contested_anchors": q_contested, "c26_j13_ratio": q_streamers_ratio,
    "p5_crop": q_crop, "c18_overlong_requests": q_overlong, "c18_replacements": q_replacements, "c19_recheck_windows": q_recheck, "c6_chorus_split": q_chorus, "c8_boundary_events": q_boundary_events, "c9_expand_anchors": q_anchors,
    "c16_review_guard": q_review_guard, "c26_j13_streamers": q_streamers, "f41_query_texts": q_query_texts, "c25_search_evidence": q_evidence, "c25_verify_titles": q_verify, "j14_supported_titles": q_supported, "j15_recover_titles": q_recover, "c27_rename_plan": q_renames,
}

_FREE = """rare AS (SELECT * FROM members WHERE title IN ('click', 'purchase')), free AS (SELECT stream_id, idx FROM segments ANTI JOIN rare USING (stream_id, idx)),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS run FROM free), gaps AS (SELECT stream_id, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM runs GROUP BY stream_id, run)"""


def _hull(source: str, name: str) -> str:
    return f"""{name}_t AS (SELECT * FROM {source} JOIN segments USING (stream_id, idx)), {name}_c AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) > {GAP} THEN 1 ELSE 0 END AS cut FROM {name}_t),
{name}_p AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, match_ord ORDER BY idx)::BIGINT AS part FROM {name}_c), {name} AS (SELECT stream_id, match_ord, part, min(idx) AS lo, max(idx) AS hi FROM {name}_p GROUP BY ALL HAVING arg_max(end_s, idx) - arg_min(start_s, idx) > {CAP})"""


_TOP = "top AS (SELECT stream_id, max(idx) AS t FROM segments GROUP BY ALL)"
_SEARCH = """q AS (SELECT item_id AS key, text AS query FROM benchmark), r AS (SELECT item_id + k AS key, (k + 1)::BIGINT AS rank, 'T' || item_id AS title, CASE WHEN item_id % 4 = 0 THEN 'zzz qqq' ELSE text END AS snippet FROM benchmark, (SELECT unnest([0, 1, 2]) AS k)),
w AS (SELECT key, rank, title, list_distinct(list_filter(regexp_split_to_array(lower(trim(query)), '\\s+'), lambda x: regexp_matches(x, '^\\pL+$'))) AS a, list_distinct(list_filter(regexp_split_to_array(lower(trim(snippet)), '\\s+'), lambda x: regexp_matches(x, '^\\pL+$'))) AS b FROM q JOIN r USING (key)),
l AS (SELECT key, rank, title, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END AS likeness FROM w), ev AS (SELECT * FROM l WHERE likeness >= 0.15 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank) = 1)"""

SQL = {
    "c9_contested_anchors": with_inputs(*_E, more="""held AS (SELECT stream_id, idx FROM members WHERE title = 'click'), fs AS (SELECT stream_id, idx, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS isl FROM segments ANTI JOIN held USING (stream_id, idx)),
nb AS (SELECT *, CASE WHEN idx % 4 = 0 THEN idx * 7919 % 10007 END AS own, last_value(CASE WHEN idx % 4 = 0 THEN idx * 7919 % 10007 END IGNORE NULLS) OVER (PARTITION BY stream_id, isl ORDER BY idx ROWS UNBOUNDED PRECEDING) AS p, first_value(CASE WHEN idx % 4 = 0 THEN idx * 7919 % 10007 END IGNORE NULLS) OVER (PARTITION BY stream_id, isl ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM fs),
ow AS (SELECT stream_id, idx, coalesce(own, least(p, n)) AS match_ord FROM nb)""", body="SELECT stream_id, match_ord, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM ow WHERE match_ord IS NOT NULL GROUP BY ALL"),
    "p5_crop": with_inputs(*_E, more=_FREE, body="SELECT m.stream_id, match_ord, any_value(title) AS title, any_value(confidence) AS confidence, min(idx) AS lo, max(idx) AS hi, count(DISTINCT idx) AS n FROM members m SEMI JOIN gaps g ON g.stream_id = m.stream_id AND m.idx BETWEEN g.lo AND g.hi AND g.n >= 2 GROUP BY m.stream_id, match_ord"),
    "c18_overlong_requests": with_inputs(*_E, more=_hull("members", "o") + ", " + _TOP, body="SELECT stream_id, match_ord, part, greatest(0, lo - 3) AS lo, least(t, hi + 3) AS hi FROM o JOIN top USING (stream_id)"),
    "c18_replacements": with_inputs(*_E, more=_hull("members", "o") + ", nw AS (SELECT * FROM members WHERE match_ord % 5 <> 0 AND (match_ord % 2 = 0 OR idx % 3 = 0)), " + _hull("nw", "s"), body="SELECT DISTINCT stream_id, match_ord, (stream_id, match_ord) IN (SELECT (stream_id, match_ord) FROM nw) AND (stream_id, match_ord) NOT IN (SELECT (stream_id, match_ord) FROM s) AS replace FROM o"),
    "c19_recheck_windows": with_inputs(*_E, more=_FREE + f""", ch AS (SELECT stream_id, c AS lo, least(hi, c + 3) AS hi FROM (SELECT *, unnest(range(lo, hi + 1, 4)) AS c FROM gaps)), {_TOP},
tg AS (SELECT c.stream_id, c.lo, c.hi, row_number() OVER (PARTITION BY c.stream_id ORDER BY c.lo, c.hi) AS k FROM ch c JOIN segments f ON f.stream_id = c.stream_id AND f.idx = c.lo JOIN segments l ON l.stream_id = c.stream_id AND l.idx = c.hi WHERE greatest(0, l.end_s - f.start_s) >= 600),
pack AS (SELECT stream_id, k, lo, hi, lo AS begin, 0::BIGINT AS w FROM tg WHERE k = 1 UNION ALL SELECT x.stream_id, x.k, x.lo, x.hi, CASE WHEN x.hi - f.begin + 1 <= 20 THEN f.begin ELSE x.lo END, CASE WHEN x.hi - f.begin + 1 <= 20 THEN f.w ELSE f.w + 1 END FROM pack f JOIN tg x ON x.stream_id = f.stream_id AND x.k = f.k + 1),
wins AS (SELECT stream_id, w, min(lo) AS lo, max(hi) AS hi, count(*) AS targets FROM pack GROUP BY ALL)""", body='SELECT stream_id, w AS "window", greatest(0, lo - 2) AS lo, least(t, hi + 2) AS hi, targets FROM wins JOIN top USING (stream_id)'),
    "c6_chorus_split": with_inputs(*_E, more=f"t AS (SELECT * FROM members JOIN segments USING (stream_id, idx)), c AS (SELECT *, start_s - lag(end_s) OVER w AS gap, lag(text) OVER w AS b FROM t WINDOW w AS (PARTITION BY stream_id, match_ord ORDER BY idx)), k AS (SELECT *, CASE WHEN gap > {GAP} OR (gap > 43200.0 AND NOT coalesce(lower(b) = lower(text) AND regexp_matches(text, '^\\pL+$'), false)) THEN 1 ELSE 0 END AS cut FROM c), p AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, match_ord ORDER BY idx)::BIGINT AS part FROM k)", body="SELECT stream_id, match_ord, part, min(idx) AS lo, max(idx) AS hi FROM p GROUP BY ALL"),
    "c8_boundary_events": with_inputs(*_E, more="r AS (SELECT stream_id, match_ord, idx, idx - row_number() OVER (PARTITION BY stream_id, match_ord ORDER BY idx) AS run FROM members), rr AS (SELECT stream_id, match_ord, min(idx) AS lo, max(idx) AS hi FROM r GROUP BY stream_id, match_ord, run), b AS (SELECT stream_id, match_ord, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS before FROM rr GROUP BY ALL), c AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) > 10000.0 THEN 1 ELSE 0 END AS cut FROM members JOIN segments USING (stream_id, idx)), p AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) AS part FROM c), h AS (SELECT stream_id, match_ord, part, min(idx) AS lo, max(idx) AS hi FROM p GROUP BY ALL), a AS (SELECT stream_id, match_ord, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS after FROM h GROUP BY ALL HAVING count(*) > 1)", body="SELECT stream_id, match_ord, before, after FROM a JOIN b USING (stream_id, match_ord)"),
    "c9_expand_anchors": with_inputs(*_E, more=_FREE + f""", seed AS (SELECT stream_id, lo AS match_ord, lo, hi, (lo + hi) // 2 AS s FROM gaps), se AS (SELECT a.*, x.end_s AS s_end FROM seed a JOIN segments x ON x.stream_id = a.stream_id AND x.idx = a.s),
lf AS (SELECT a.stream_id, a.match_ord, max(x.idx) FILTER (NOT a.s_end - x.start_s <= {CAP}) AS stop FROM se a JOIN segments x ON x.stream_id = a.stream_id AND x.idx >= a.lo AND x.idx < a.s GROUP BY ALL),
lw AS (SELECT a.*, greatest(a.lo, coalesce(stop + 1, a.lo)) AS l FROM se a LEFT JOIN lf USING (stream_id, match_ord)), ls AS (SELECT a.*, x.start_s AS l_start FROM lw a JOIN segments x ON x.stream_id = a.stream_id AND x.idx = a.l),
rf AS (SELECT a.stream_id, a.match_ord, min(x.idx) FILTER (NOT x.end_s - a.l_start <= {CAP}) AS stop FROM ls a JOIN segments x ON x.stream_id = a.stream_id AND x.idx > a.s AND x.idx <= a.hi GROUP BY ALL)""", body="SELECT a.stream_id, a.match_ord, a.l AS lo, least(a.hi, coalesce(stop - 1, a.hi)) AS hi FROM ls a LEFT JOIN rf USING (stream_id, match_ord)"),
    "c16_review_guard": with_inputs(*_E, more="b AS (SELECT * FROM members), a AS (SELECT * FROM b WHERE (match_ord <> 2 OR stream_id % 3 <> 0) AND stream_id % 11 <> 0), lost AS (SELECT DISTINCT stream_id FROM (SELECT DISTINCT stream_id, title FROM b EXCEPT SELECT DISTINCT stream_id, title FROM a)), clash AS (SELECT DISTINCT x.stream_id FROM a x JOIN a y ON x.stream_id = y.stream_id AND x.idx = y.idx AND x.match_ord < y.match_ord AND x.title <> y.title), sz AS (SELECT stream_id, max(idx) - min(idx) + 1 AS n FROM a GROUP BY ALL)", body="SELECT DISTINCT b.stream_id, coalesce(n <= 14, false) AND b.stream_id NOT IN (SELECT stream_id FROM lost) AND b.stream_id NOT IN (SELECT stream_id FROM clash) AS accepted FROM b LEFT JOIN sz USING (stream_id)"),
    "c26_j13_streamers": "WITH p AS (SELECT o_orderkey AS key, o_orderdate, s_suppkey, s_name FROM orders JOIN supplier ON o_custkey % 50 = s_suppkey) SELECT key, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_suppkey ELSE 'unknown' END AS streamer, strftime(o_orderdate, '%y%m%d') AS date, CASE WHEN s_suppkey % 2 = 1 THEN 0 WHEN key % 3 = 0 THEN 0.92 ELSE 1 END::DOUBLE AS score FROM p",
    "f41_query_texts": with_inputs(*_E, more="""hd AS (SELECT stream_id, match_ord, any_value(title) AS title FROM members GROUP BY ALL),
tx AS (SELECT stream_id, match_ord, text, row_number() OVER (PARTITION BY stream_id, match_ord ORDER BY idx) - 1 AS p, count(*) OVER (PARTITION BY stream_id, match_ord) AS n FROM members JOIN segments USING (stream_id, idx) WHERE length(trim(text)) > 2),
md AS (SELECT stream_id, match_ord, substr(string_agg(text, ' ' ORDER BY p), 1, 100) AS q FROM tx WHERE p >= n // 2 - 2 AND p < n // 2 + 3 GROUP BY ALL)""", body="SELECT hd.stream_id, hd.match_ord, CASE WHEN hd.match_ord % 3 = 0 AND length(title) >= 5 THEN title WHEN hd.match_ord % 3 = 1 THEN 'song ' || hd.match_ord ELSE coalesce(q, '') END AS query FROM hd LEFT JOIN md USING (stream_id, match_ord)"),
    "c25_search_evidence": f"WITH {_SEARCH} SELECT * FROM ev",
    "c25_verify_titles": f"WITH {_SEARCH} SELECT q.key, CASE WHEN ev.title IS NOT NULL AND q.key % 2 = 0 THEN ev.title WHEN q.key % 2 = 0 THEN '未知歌曲：x' ELSE 'own' END AS title, CASE WHEN ev.title IS NULL THEN 'no_evidence' WHEN q.key % 2 = 0 THEN 'renamed' ELSE 'confirmed' END AS verdict FROM q LEFT JOIN ev ON ev.key = q.key",
    "j14_supported_titles": f"WITH {_SEARCH}, m AS (SELECT key, CASE WHEN key % 3 = 0 THEN 't' || key ELSE 'missing' END AS title FROM q) SELECT m.key, coalesce(bool_or(contains(lower(r.title || ' ' || snippet), m.title)), false) AS supported FROM m LEFT JOIN r ON r.key = m.key GROUP BY ALL",
    "j15_recover_titles": "SELECT s_suppkey % 5 AS folder, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey || '-' || chr(65533) ELSE 'x' || lpad(s_suppkey::VARCHAR, 4, '0') || chr(65533) END AS stem, lpad(s_suppkey::VARCHAR, 4, '0') || ' name' AS title FROM supplier WHERE s_suppkey % 7 <> 0",
    "c27_rename_plan": "WITH c AS (SELECT c_custkey % 10 AS folder, lpad(c_custkey::VARCHAR, 6, '0') AS stem, '【S】t' || c_custkey % 7 || '-260603' AS base FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY stem) AS n FROM c) SELECT folder, stem, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS target FROM n",
}
