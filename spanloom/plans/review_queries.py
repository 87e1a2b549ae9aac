"""Queries of review, audit and run gates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import intervals as iv, matches as mt, review as rv
from spanloom.plans import match_queries as mq, protocol_queries as pq, stage_queries as sq
from spanloom.plans.inputs import members, segments, table, usage, with_inputs
from spanloom.sources.checkpoints import cut

_E = ("segments", "members")


def _clusters(spark, d):
    """Ten neighbouring matches of a stream as a cluster, every third left out."""
    return mt.heads(members(spark, d)).where("match_ord % 3 <> 0").select("stream_id", "match_ord", F.floor(F.col("match_ord") / 10).alias("cluster"))


def q_outside(spark, d):
    return mt.heads(rv.outside_clusters(members(spark, d), _clusters(spark, d)))


def q_inside(spark, d):
    targets = segments(spark, d).groupBy("stream_id").agg(F.lit(5).cast("long").alias("lo"), (F.max("idx") - 5).alias("hi"))
    return rv.inside_targets(rv.cluster_ranges(members(spark, d), _clusters(spark, d)), targets)


def q_audited(spark, d):
    return rv.all_audited(_clusters(spark, d), mt.heads(members(spark, d)).where("match_ord % 25 <> 4"))


def q_sanitise(spark, d):
    m = members(spark, d)
    targets = iv.uncovered(segments(spark, d), pq._rare(spark, d), 2)
    return mt.heads(rv.sanitise_review(m, m.where("title = 'click'"), targets, segments(spark, d), gap_s=-1.0)).select("stream_id", "match_ord", "lo", "hi", "n")


def q_audit(spark, d):
    m = members(spark, d).withColumn("title", F.when(F.col("match_ord") % 7 == 0, "聊天").otherwise(F.col("title")))
    targets = iv.uncovered(segments(spark, d), pq._rare(spark, d), 2)
    failed = segments(spark, d).where("stream_id % 4 = 0").select("stream_id")
    return mt.heads(rv.full_audit(m, m.where("match_ord % 2 = 0"), targets, failed)).select("stream_id", "match_ord", "lo", "hi", "n")


def q_anchor_recheck(spark, d):
    """Anchors of one segment in the middle of each long uncovered range, where that segment is long enough itself."""
    free = iv.uncovered(segments(spark, d), pq._rare(spark, d), 1)
    a = free.select("stream_id", F.col("lo").alias("match_ord"), F.lit("x").alias("title"), F.lit(0.5).alias("confidence"), F.floor((F.col("lo") + F.col("hi")) / 2).alias("idx"))
    grown = rv.anchor_recheck(a, pq._rare(spark, d), segments(spark, d), least_s=100.0, most=6, gap_s=1e12, cap_s=1e12)
    return grown.groupBy("stream_id", "match_ord").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))


def _temporal(spark, d):
    """Matches of twelve segments over sources of three; logs of every kind."""
    k, segs = F.col("match_ord"), cut(segments(spark, d))
    wide = segs.where("idx % 36 < 30").select("stream_id", F.floor(F.col("idx") / 12).alias("match_ord"), "idx")
    wide = wide.select("stream_id", "match_ord", F.when(k % 3 == 0, "未知歌曲：t").otherwise(F.concat(F.lit("t"), k % 2)).alias("title"), F.lit(0.6).alias("confidence"), "idx")
    s = F.col("stream_id")
    logs = segs.where("idx < 2").select("stream_id", (s % 7 != 1).alias("readable"), F.when((s % 5 == 2) & (F.col("idx") == 0), "timeout").alias("error"), F.when(s % 9 == 4, "length").otherwise("stop").alias("finish_reason"), ((s % 8 != 3) | (F.col("idx") == 0)).alias("parse_valid"))
    return rv.temporal_run(wide, mq.iv_pieces(spark, d).where("match_ord % 2 = 0 or stream_id % 2 = 0"), logs, segs, gap_s=mq.GAP, cap_s=mq.SOFT_MAX)


def q_temporal(spark, d):
    return mt.heads(_temporal(spark, d)[0])


def q_temporal_audit(spark, d):
    return _temporal(spark, d)[1]


def q_gates(spark, d):
    m = members(spark, d)
    required = segments(spark, d).select("stream_id").distinct().withColumn("title", F.when(F.col("stream_id") % 2 == 0, "CLICK").otherwise("never"))
    return rv.run_gates(m, required, usage(spark, d), least=52, most_calls=620, most_completion=10**9)


def q_folders(spark, d):
    files = segments(spark, d).select((F.col("stream_id") % 8).alias("folder"), "stream_id").distinct()
    return rv.folder_counts(files, members(spark, d))


def q_responses(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    r = c.select(F.col("conv_id").alias("stream_id"), F.concat(F.lit("p"), "turn").alias("phase"), F.when(F.col("turn") % 2 == 0, " ").otherwise(F.col("text")).alias("content"), F.concat(F.lit("why "), "text").alias("reasoning"), F.when(F.col("turn") % 3 == 0, "length").alias("finish_reason"))
    return rv.response_rows(r)


def q_requests(spark, d):
    return rv.review_requests(members(spark, d), _clusters(spark, d), segments(spark, d), 2)


def q_range_items(spark, d):
    h = mt.heads(members(spark, d))
    pair = F.struct(F.col("lo").alias("lo"), F.least(F.col("hi"), F.col("lo") + 3).alias("hi"))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    items = h.select("stream_id", F.col("match_ord").alias("pos"), F.when(F.col("match_ord") % 3 == 0, F.array("hi")).otherwise(F.array().cast("array<bigint>")).alias("indices"), F.when(F.col("match_ord") % 2 == 0, F.array(pair)).otherwise(none).alias("ranges"))
    return rv.range_items(items).select("stream_id", "pos", F.array_join("indices", ",").alias("indices"))


def q_types(spark, d):
    u = usage(spark, d)
    on = rv.of_types(u, {"content_types": {"song": True, "dialogue": False}})
    return on.groupBy("stream_id").agg(F.count("*").alias("n"))


QUERIES = {
    "j7_outside_clusters": q_outside, "j8_inside_targets": q_inside, "j9_all_audited": q_audited, "c17_sanitise_review": q_sanitise, "c20_full_audit": q_audit, "c21_anchor_recheck": q_anchor_recheck, "c24_temporal_run": q_temporal, "c24_temporal_audit": q_temporal_audit,
    "a10_run_gates": q_gates, "a12_folder_counts": q_folders, "m12_response_rows": q_responses, "m11_review_requests": q_requests, "p2_range_items": q_range_items, "p4_enabled_types": q_types,
}

_H = f"hd AS ({mq._HEADS.format('members')}), cl AS (SELECT stream_id, match_ord, match_ord // 10 AS cluster, lo, hi, title FROM hd WHERE match_ord % 3 <> 0), cr AS (SELECT stream_id, cluster, min(lo) AS lo, max(hi) AS hi, count(*) AS candidates FROM cl GROUP BY ALL), top AS (SELECT stream_id, max(idx) AS t FROM segments GROUP BY ALL)"
_FREE = """rare AS (SELECT * FROM members WHERE title IN ('click', 'purchase')), free AS (SELECT stream_id, idx FROM segments ANTI JOIN rare USING (stream_id, idx)),
fr AS (SELECT *, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS run FROM free), gaps AS (SELECT stream_id, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM fr GROUP BY stream_id, run), tgt AS (SELECT stream_id, unnest(range(lo, hi + 1)) AS idx FROM gaps WHERE n >= 2)"""
_SHORT = "SELECT stream_id, match_ord, min(idx) AS lo, max(idx) AS hi, count(DISTINCT idx) AS n FROM {} GROUP BY ALL"

_TEMPORAL = f"""w AS (SELECT stream_id, idx // 12 AS match_ord, CASE WHEN idx // 12 % 3 = 0 THEN '未知歌曲：t' ELSE 't' || (idx // 12 % 2) END AS title, idx FROM segments WHERE idx % 36 < 30), src AS (SELECT stream_id, idx // 3 AS o, 't' || (idx // 3 % 2) AS key, idx FROM segments WHERE idx // 3 % 2 = 0 OR stream_id % 2 = 0),
lg AS (SELECT stream_id, stream_id % 7 <> 1 AS r, stream_id % 5 = 2 AND idx = 0 AS e, stream_id % 9 = 4 AS l, stream_id % 8 <> 3 OR idx = 0 AS p FROM segments WHERE idx < 2),
gt AS (SELECT stream_id, bool_or(r AND NOT e AND p) AS good, bool_or(NOT r) AS f1, bool_or(r AND NOT p) AS f2, bool_or(r AND l) AS f3 FROM lg GROUP BY ALL), g AS (SELECT stream_id, good AND NOT f1 AND NOT f2 AND NOT f3 AS valid, array_to_string(list_filter([CASE WHEN f1 THEN 'invalid_debug' END, CASE WHEN f2 THEN 'invalid_result_json' END, CASE WHEN f3 THEN 'output_truncated' END], lambda x: x IS NOT NULL), ',') AS failures FROM gt),
v AS (SELECT stream_id FROM g WHERE valid), wv AS (SELECT * FROM w SEMI JOIN v USING (stream_id)), sv AS (SELECT * FROM src SEMI JOIN v USING (stream_id)),
t AS (SELECT stream_id, match_ord, min(idx) AS lo, max(idx) AS hi FROM wv GROUP BY ALL), sh AS (SELECT stream_id, o, any_value(key) AS key, min(idx) AS slo, max(idx) AS shi, count(*) AS sn FROM sv GROUP BY ALL),
cn AS (SELECT a.stream_id, a.match_ord, s.o, count(*) AS shared FROM wv a JOIN sv s ON s.stream_id = a.stream_id AND s.idx = a.idx GROUP BY ALL),
sup AS (SELECT c.stream_id, c.match_ord, c.o, key, slo, shi, lead(slo) OVER z AS nxt, row_number() OVER z AS k FROM cn c JOIN sh ON sh.stream_id = c.stream_id AND sh.o = c.o WHERE shared * 2 >= sn WINDOW z AS (PARTITION BY c.stream_id, c.match_ord ORDER BY slo, c.o)),
ok AS (SELECT stream_id, match_ord FROM sup GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT key) >= 2 AND bool_and(nxt IS NULL OR shi < nxt)), ct AS (SELECT *, (shi + nxt) // 2 AS e FROM sup SEMI JOIN ok USING (stream_id, match_ord)),
pt AS (SELECT * FROM (SELECT c.stream_id, c.match_ord, k AS part, greatest(lo, coalesce(lag(e) OVER (PARTITION BY c.stream_id, c.match_ord ORDER BY k) + 1, lo)) AS lo, least(hi, coalesce(e, hi)) AS hi FROM ct c JOIN t ON t.stream_id = c.stream_id AND t.match_ord = c.match_ord) WHERE lo <= hi UNION ALL SELECT stream_id, match_ord, 1, lo, hi FROM t ANTI JOIN ok USING (stream_id, match_ord)),
pn AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY match_ord, part) AS new FROM pt), rf AS (SELECT a.stream_id, new AS match_ord, title, idx FROM wv a JOIN pn ON pn.stream_id = a.stream_id AND pn.match_ord = a.match_ord AND idx BETWEEN lo AND hi),
bc AS (SELECT a.stream_id, a.match_ord, s.o, count(*) AS shared, any_value(key) AS key FROM rf a JOIN sv s ON s.stream_id = a.stream_id AND s.idx = a.idx GROUP BY ALL), bo AS (SELECT * FROM bc QUALIFY row_number() OVER (PARTITION BY stream_id, match_ord ORDER BY shared DESC, o) = 1),
nm AS (SELECT r.stream_id, 0 AS k, r.match_ord, CASE WHEN key IS NOT NULL THEN key WHEN title LIKE '未知歌曲%' THEN '未知歌曲：时序裁决新增区间' ELSE title END AS title, CASE WHEN key IS NOT NULL THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS confidence, idx FROM rf r LEFT JOIN bo ON bo.stream_id = r.stream_id AND bo.match_ord = r.match_ord),
tc AS (SELECT DISTINCT s.stream_id, s.o FROM sv s SEMI JOIN rf r ON r.stream_id = s.stream_id AND r.idx = s.idx), al AS (SELECT * FROM nm UNION ALL SELECT stream_id, 1, o, key, 0.7::DOUBLE, idx FROM sv ANTI JOIN tc USING (stream_id, o)),
ls AS (SELECT stream_id, dense_rank() OVER (PARTITION BY stream_id ORDER BY k, match_ord) - 1 AS match_ord, title, confidence, idx FROM al), {sq._norm(mq.SOFT_MAX, 'ls')},
fin AS (SELECT stream_id, match_ord, title, confidence, idx FROM norm UNION ALL SELECT stream_id, o, key, 0.7::DOUBLE, idx FROM src SEMI JOIN (SELECT stream_id FROM g WHERE NOT valid) USING (stream_id))"""

SQL = {
    "c24_temporal_run": with_inputs("segments", more=_TEMPORAL, body=mq._HEADS.format("fin")),
    "c24_temporal_audit": with_inputs("segments", more=_TEMPORAL, body="""SELECT g.stream_id, CASE WHEN valid THEN 'success' ELSE 'fallback_source' END AS status, failures, coalesce(a.n, 0) AS input, coalesce(b.n, 0) AS temporal, coalesce(c.n, 0) AS refined, coalesce(e.n, 0) AS output FROM g
LEFT JOIN (SELECT stream_id, count(DISTINCT o) AS n FROM src GROUP BY ALL) a USING (stream_id) LEFT JOIN (SELECT stream_id, count(DISTINCT match_ord) AS n FROM wv GROUP BY ALL) b USING (stream_id) LEFT JOIN (SELECT stream_id, count(DISTINCT match_ord) AS n FROM rf GROUP BY ALL) c USING (stream_id) LEFT JOIN (SELECT stream_id, count(DISTINCT match_ord) AS n FROM fin GROUP BY ALL) e USING (stream_id)"""),
    "j7_outside_clusters": with_inputs(*_E, more=_H, body="SELECT * FROM hd WHERE match_ord % 3 = 0"),
    "j8_inside_targets": with_inputs(*_E, more=_H, body="SELECT cr.* FROM cr JOIN top USING (stream_id) WHERE lo >= 5 AND hi <= t - 5"),
    "j9_all_audited": with_inputs(*_E, more=_H, body="SELECT stream_id, cluster FROM cl GROUP BY ALL HAVING bool_and(match_ord % 25 <> 4)"),
    "c17_sanitise_review": with_inputs(*_E, more=_FREE + ", old AS (SELECT DISTINCT stream_id, idx FROM members WHERE title = 'click'), touch AS (SELECT DISTINCT stream_id, match_ord FROM members SEMI JOIN old USING (stream_id, idx)), k AS (SELECT stream_id, match_ord, lower(title) AS title, idx FROM members SEMI JOIN touch USING (stream_id, match_ord) UNION ALL SELECT stream_id, match_ord, lower(title), idx FROM members ANTI JOIN touch USING (stream_id, match_ord) SEMI JOIN tgt USING (stream_id, idx)), hk AS (SELECT stream_id, match_ord, title, min(idx) AS lo, max(idx) AS hi FROM k GROUP BY ALL), c AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY stream_id, title ORDER BY lo, match_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS cut FROM hk), p AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, title ORDER BY lo, match_ord) AS part FROM c), g AS (SELECT *, (min(row(lo, match_ord)) OVER (PARTITION BY stream_id, title, part))[2] AS grp FROM p), z AS (SELECT k.stream_id, grp AS match_ord, k.idx FROM k JOIN g USING (stream_id, match_ord))", body=_SHORT.format("z")),
    "c20_full_audit": with_inputs(*_E, more=_FREE + ", z AS (SELECT stream_id, match_ord, idx FROM members SEMI JOIN tgt USING (stream_id, idx) WHERE match_ord % 7 <> 0 AND (stream_id % 4 <> 0 OR match_ord % 2 = 0))", body=_SHORT.format("z")),
    "c21_anchor_recheck": with_inputs(*_E, more=_FREE + ", s AS (SELECT g.stream_id, g.lo, g.hi, l.end_s - f.start_s AS secs, m.end_s - m.start_s AS own FROM gaps g JOIN segments f ON f.stream_id = g.stream_id AND f.idx = g.lo JOIN segments l ON l.stream_id = g.stream_id AND l.idx = g.hi JOIN segments m ON m.stream_id = g.stream_id AND m.idx = (g.lo + g.hi) // 2)", body="SELECT stream_id, lo AS match_ord, lo, hi FROM s WHERE secs >= 100 AND own >= 10"),
    "a10_run_gates": with_inputs(*_E, "usage", more="n AS (SELECT stream_id, count(DISTINCT match_ord) AS matches, bool_or(title = 'click') AS click FROM members GROUP BY ALL), u AS (SELECT stream_id, count(*) AS calls, sum(completion)::BIGINT AS completion FROM usage GROUP BY ALL), x AS (SELECT n.stream_id, matches, CASE WHEN n.stream_id % 2 = 0 AND click THEN 0 ELSE 1 END::BIGINT AS missing, coalesce(calls, 0) AS calls, coalesce(completion, 0) AS completion FROM n LEFT JOIN u USING (stream_id))", body="SELECT *, CASE WHEN missing = 0 AND matches >= 52 AND calls <= 620 THEN 'pass' ELSE 'fail' END AS verdict FROM x"),
    "a12_folder_counts": with_inputs(*_E, more="c AS (SELECT stream_id % 8 AS folder, title, count(DISTINCT (stream_id, match_ord)) AS n FROM members GROUP BY ALL), r AS (SELECT stream_id % 8 AS folder, count(DISTINCT stream_id) AS recordings FROM segments GROUP BY ALL)", body="SELECT folder, any_value(recordings) AS recordings, string_agg(title || ':' || n, ',' ORDER BY title) AS counts FROM r JOIN c USING (folder) GROUP BY folder"),
    "m12_response_rows": "WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) SELECT conv_id AS stream_id, 'p' || turn AS phase, coalesce(CASE WHEN turn % 2 = 1 THEN nullif(trim(text), '') END, trim('why ' || text), '') AS text, CASE WHEN turn % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason FROM c",
    "m11_review_requests": with_inputs(*_E, more=_H + ", j AS (SELECT stream_id, cluster, '[' || string_agg('{\"id\":' || match_ord || ',\"title\":\"' || title || '\",\"lo\":' || lo || ',\"hi\":' || hi || '}', ',' ORDER BY match_ord) || ']' AS candidates_json FROM cl GROUP BY ALL)", body="SELECT stream_id, cluster, greatest(0, lo - 2) AS lo, least(t, hi + 2) AS hi, candidates_json FROM cr JOIN j USING (stream_id, cluster) JOIN top USING (stream_id)"),
    "p2_range_items": with_inputs(*_E, more=_H, body="SELECT stream_id, match_ord AS pos, CASE WHEN match_ord % 2 = 0 THEN array_to_string(range(lo, least(hi, lo + 3) + 1), ',') ELSE hi::VARCHAR END AS indices FROM hd WHERE match_ord % 2 = 0 OR match_ord % 3 = 0"),
    "p4_enabled_types": "SELECT l_suppkey AS stream_id, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL",
}
