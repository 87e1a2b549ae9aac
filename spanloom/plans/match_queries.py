"""Queries of the operators on candidate matches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import evaluation as ev, intervals as iv, matches as mt
from spanloom.plans.inputs import both, members, segments, usage, with_inputs
from spanloom.sources.checkpoints import by_stream

_E = ("segments", "members")
GAP, SOFT_MIN, SOFT_MAX, RISK_GAP = 86400.0, 86400.0, 432000.0, 43200.0


def _parted(rows, segs, gap):
    """Members whose matches are the parts left by gaps longer than gap."""
    parts = iv.split_at_gaps(rows, segs, gap)
    return parts.select("stream_id", (F.col("match_ord") * 1000 + F.col("part")).alias("match_ord"), "title", "confidence", "idx")


def _islands(spark, d, gap):
    return _parted(members(spark, d), segments(spark, d), gap)


def q_same_title(spark, d):
    return mt.heads(mt.merge_same_title(members(spark, d), segments(spark, d), GAP))


def q_same_title_neighbours(spark, d):
    return mt.heads(mt.merge_same_title(members(spark, d), segments(spark, d), GAP, neighbours_only=True))


def q_duplicates(spark, d):
    m = members(spark, d)
    return mt.drop_duplicates(m.union(m.where("match_ord % 3 = 0").withColumn("match_ord", F.col("match_ord") + 10_000)))


def q_measures(spark, d):
    return mt.measures(members(spark, d), segments(spark, d))


def q_risks(spark, d):
    return mt.risks(members(spark, d), segments(spark, d), soft_min=SOFT_MIN, soft_max=SOFT_MAX, gap=RISK_GAP)


def _weak(rows):
    return mt.heads(rows).where("confidence < 0.3").select("stream_id", "match_ord")


def _suspicious(spark, d):
    return _weak(members(spark, d))


def q_edges(spark, d):
    return mt.conflict_edges(members(spark, d), _suspicious(spark, d), span=12, nearby=0)


def _clustered(rows):
    s = _weak(rows)
    return mt.clusters(mt.conflict_edges(rows, s, span=12), s)


def q_clusters(spark, d):
    return _clustered(by_stream(members(spark, d)))


def q_select(spark, d):
    searched = spark.createDataFrame([("click",)], "title string")
    rows, segs = both(spark, d)
    return mt.select_best(rows, _clustered(rows), segs, searched, SOFT_MAX)


def q_best_overlap(spark, d):
    return mt.best_overlap(_islands(spark, d, GAP), members(spark, d))


def q_restore(spark, d):
    temporal = members(spark, d).where("match_ord % 2 = 0").withColumn("title", F.expr("case when match_ord % 4 = 0 then '未知歌曲：x' when match_ord % 6 = 0 then 'view' else title end"))
    return mt.restore_titles(temporal, _islands(spark, d, GAP))


def _wide(spark, d):
    """Two days of a stream as one match each, over all its titles."""
    return members(spark, d).groupBy("stream_id", F.floor(F.col("idx") / 12).alias("match_ord"), "idx").agg(F.min("title").alias("title"), F.min("confidence").alias("confidence"))


def q_split_sources(spark, d):
    return mt.split_at_sources(_wide(spark, d), iv_pieces(spark, d))


def iv_pieces(spark, d):
    """Sources of at most three neighbouring segments, alternating titles."""
    rows = segments(spark, d).select("stream_id", F.floor(F.col("idx") / 3).alias("match_ord"), "idx")
    return rows.select("stream_id", "match_ord", F.concat(F.lit("t"), F.col("match_ord") % 2).alias("title"), F.lit(0.7).alias("confidence"), "idx")


def q_evaluate(spark, d):
    return mt.evaluate(_islands(spark, d, GAP), members(spark, d))


def _profile(spark, given, segs, rows, usage_rows):
    """A profile's metrics against the confident matches; two titles are watched and looked for."""
    titles = spark.createDataFrame([("click",), ("view",)], "title string")
    estimates = segs.select("stream_id").distinct().select("stream_id", (F.col("stream_id") % 5 / 1000.0).alias("estimated_usd"))
    return ev.profile_metrics(rows, segs, ev.weak_truth(given), usage_rows, estimates=estimates, protected=titles, watched=titles)


def _candidate(given, segs):
    """Parts of matches; in every third stream those of one title come twice."""
    isl = by_stream(_parted(given, segs, GAP))
    return isl.union(isl.where("stream_id % 3 = 0 and title = 'view'").withColumn("match_ord", F.col("match_ord") + 500))


def q_metrics(spark, d):
    given, segs = both(spark, d)
    return _profile(spark, given, segs, _candidate(given, segs), usage(spark, d).where("content_type = 'song'"))


def q_gates(spark, d):
    """Each stream's candidate profile against its baseline: the seven acceptance gates."""
    given, segs = both(spark, d)
    spent = usage(spark, d)
    base = _profile(spark, given, segs, given, spent)
    return ev.gates(_profile(spark, given, segs, _candidate(given, segs), spent.where("content_type = 'song'")), base)


QUERIES = {
    "c4_merge_same_title": q_same_title, "c5_merge_neighbours": q_same_title_neighbours, "u2_drop_duplicates": q_duplicates, "a1_measures": q_measures, "c10_risks": q_risks,
    "c12_conflict_edges": q_edges, "c12_clusters": q_clusters, "c13_select_best": q_select, "j10_best_overlap": q_best_overlap, "c23_restore_titles": q_restore,
    "c22_split_at_sources": q_split_sources, "a7_evaluate": q_evaluate, "a7_profile_metrics": q_metrics, "a9_gates": q_gates,
}

_HEADS = "SELECT stream_id, match_ord, any_value(title) AS title, any_value(confidence) AS confidence, min(idx) AS lo, max(idx) AS hi, count(DISTINCT idx) AS n FROM {} GROUP BY stream_id, match_ord"
_H = f"heads AS ({_HEADS.format('members')}), ends AS (SELECT h.*, lower(trim(title)) AS key, f.start_s AS lo_s, l.end_s AS hi_s FROM heads h JOIN segments f ON f.stream_id = h.stream_id AND f.idx = h.lo JOIN segments l ON l.stream_id = h.stream_id AND l.idx = h.hi)"


def _merge_sql(neighbours: bool) -> str:
    run = "sum(c) OVER (PARTITION BY stream_id ORDER BY lo, match_ord)" if neighbours else "0"
    sign = "" if neighbours else "-"
    return f"""{_H}, changes AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY stream_id ORDER BY lo, match_ord) = key THEN 0 ELSE 1 END AS c FROM ends),
runs AS (SELECT *, {run} AS run FROM changes),
past AS (SELECT *, max(hi) OVER w AS b_hi, max(row(hi, hi_s)) OVER w AS b FROM runs WINDOW w AS (PARTITION BY stream_id, key, run ORDER BY lo, match_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (SELECT *, CASE WHEN b_hi IS NULL OR (lo > b_hi AND lo_s - b[2] > {GAP}) THEN 1 ELSE 0 END AS cut FROM past),
parts AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, key, run ORDER BY lo, match_ord) AS part FROM cuts),
grp AS (SELECT stream_id, match_ord, min(row(lo, match_ord)) OVER g AS first, max(row(confidence, {sign}lo, {sign}match_ord, title)) OVER g AS best FROM parts WINDOW g AS (PARTITION BY stream_id, key, run, part)),
merged AS (SELECT DISTINCT stream_id, first[2] AS match_ord, best[4] AS title, best[1] AS confidence, idx FROM members JOIN grp USING (stream_id, match_ord))"""


_MEASURES = f"""{_H}, gaps AS (SELECT stream_id, match_ord, greatest(0, lead(start_s) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) - end_s) AS gap, CASE WHEN lead(start_s) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) IS NULL THEN NULL ELSE 1 END AS has, round(greatest(0, end_s - start_s) * 1e6)::BIGINT AS us FROM members JOIN segments USING (stream_id, idx)),
sums AS (SELECT stream_id, match_ord, sum(us)::BIGINT / 1e6::DOUBLE AS speech_s, coalesce(max(gap) FILTER (has = 1), 0)::DOUBLE AS max_gap_s FROM gaps GROUP BY ALL),
measures AS (SELECT e.*, greatest(0, hi_s - lo_s) AS duration_s, speech_s, max_gap_s FROM ends e JOIN sums USING (stream_id, match_ord))"""
_RISKS = f"""{_MEASURES}, pair AS (SELECT DISTINCT a.stream_id, a.match_ord, b.match_ord AS o FROM members a JOIN members b ON a.stream_id = b.stream_id AND a.idx = b.idx AND a.match_ord <> b.match_ord),
stops AS (SELECT p.stream_id, p.match_ord, min(o) AS stop FROM pair p JOIN ends x ON x.stream_id = p.stream_id AND x.match_ord = p.match_ord JOIN ends y ON y.stream_id = p.stream_id AND y.match_ord = p.o WHERE x.key <> y.key GROUP BY ALL),
apart AS (SELECT x.stream_id, x.match_ord, max(CASE WHEN x.lo > y.hi THEN x.lo_s - y.hi_s ELSE y.lo_s - x.hi_s END) AS far FROM ends x JOIN ends y ON x.stream_id = y.stream_id AND x.key = y.key AND x.match_ord <> y.match_ord LEFT JOIN stops s ON s.stream_id = x.stream_id AND s.match_ord = x.match_ord
  WHERE (stop IS NULL OR y.match_ord < stop) AND greatest(x.lo, y.lo) > least(x.hi, y.hi) AND (CASE WHEN x.lo > y.hi THEN x.lo_s - y.hi_s ELSE y.lo_s - x.hi_s END) > {RISK_GAP} GROUP BY ALL),
feature AS (SELECT m.stream_id, m.match_ord, m.title, duration_s, far, stop, duration_s < {SOFT_MIN} AS short, duration_s > {SOFT_MAX} AS long, key = '' OR key LIKE '未知歌曲%' OR key LIKE 'unknown%' AS unk,
  CASE WHEN duration_s < {SOFT_MIN} THEN least(1.0::DOUBLE, ({SOFT_MIN}::DOUBLE - duration_s) / {SOFT_MIN}::DOUBLE) WHEN duration_s > {SOFT_MAX} THEN least(1.0::DOUBLE, (duration_s - {SOFT_MAX}::DOUBLE) / {SOFT_MAX}::DOUBLE + 0.5) ELSE 0 END::DOUBLE AS duration,
  greatest(CASE WHEN duration_s > 0 THEN 1.0::DOUBLE - least(1.0::DOUBLE, speech_s / duration_s) ELSE 1 END, least(1.0::DOUBLE, max_gap_s / {RISK_GAP}::DOUBLE)) AS boundary,
  CASE WHEN stop IS NOT NULL THEN 1 WHEN far IS NOT NULL THEN least(1.0::DOUBLE, far / {SOFT_MAX}::DOUBLE) ELSE 0 END::DOUBLE AS overlap, confidence
  FROM measures m LEFT JOIN stops s ON s.stream_id = m.stream_id AND s.match_ord = m.match_ord LEFT JOIN apart a ON a.stream_id = m.stream_id AND a.match_ord = m.match_ord),
evid AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.65::DOUBLE - confidence) / 0.65::DOUBLE), CASE WHEN unk THEN 0.35::DOUBLE ELSE 0.25::DOUBLE END) AS evidence FROM feature),
scored AS (SELECT *, (duration * 1.0::DOUBLE + boundary * 2.0::DOUBLE + overlap * 2.0::DOUBLE + evidence * 2.0::DOUBLE) / 7.0::DOUBLE AS score FROM evid)"""
_EDGES = """h AS (SELECT stream_id, match_ord, lower(trim(any_value(title))) AS key, any_value(confidence) AS confidence, min(idx) AS lo, max(idx) AS hi FROM members GROUP BY ALL),
share AS (SELECT DISTINCT a.stream_id, a.match_ord AS a, b.match_ord AS b FROM members a JOIN members b ON a.stream_id = b.stream_id AND a.idx = b.idx AND a.match_ord < b.match_ord),
edges AS (SELECT x.stream_id, x.match_ord AS a, y.match_ord AS b FROM h x JOIN h y ON x.stream_id = y.stream_id AND x.match_ord < y.match_ord LEFT JOIN share s ON s.stream_id = x.stream_id AND s.a = x.match_ord AND s.b = y.match_ord
  WHERE (x.key <> y.key AND s.a IS NOT NULL) OR (x.key = y.key AND x.confidence < 0.3 AND y.confidence < 0.3 AND greatest(x.hi, y.hi) - least(x.lo, y.lo) + 1 <= 12){near})"""
_NEAR = " OR (x.key <> y.key AND greatest(x.lo, y.lo) - least(x.hi, y.hi) - 1 = 0 AND greatest(x.hi, y.hi) - least(x.lo, y.lo) + 1 <= 12)"
_CLUSTERS = (
    _EDGES.format(near="")
    + """, both_ways AS (SELECT stream_id, a, b FROM edges UNION SELECT stream_id, b, a FROM edges),
start AS (SELECT stream_id, a AS match_ord FROM both_ways UNION SELECT stream_id, match_ord FROM h WHERE confidence < 0.3),
reach AS (SELECT stream_id, match_ord, match_ord AS c FROM start UNION SELECT r.stream_id, e.b, r.c FROM reach r JOIN both_ways e ON e.stream_id = r.stream_id AND e.a = r.match_ord),
clusters AS (SELECT stream_id, match_ord, min(c) AS cluster FROM reach GROUP BY ALL)"""
)
_SELECT = (
    _CLUSTERS
    + f""", times AS (SELECT h.stream_id, h.match_ord, key, h.confidence, greatest(0, l.end_s - f.start_s) AS d FROM h JOIN segments f ON f.stream_id = h.stream_id AND f.idx = h.lo JOIN segments l ON l.stream_id = h.stream_id AND l.idx = h.hi),
sets AS (SELECT stream_id, match_ord, list(idx) AS ids FROM members GROUP BY ALL),
ranked AS (SELECT c.stream_id, c.match_ord, cluster, ids, row_number() OVER (PARTITION BY c.stream_id, cluster ORDER BY (contains(key, 'click') OR contains('click', key))::INT DESC, (key NOT LIKE '未知歌曲%')::INT DESC, t.confidence DESC, (d <= {SOFT_MAX})::INT DESC, least(0, {SOFT_MAX}::DOUBLE - d) DESC, c.match_ord) AS k
  FROM clusters c JOIN times t ON t.stream_id = c.stream_id AND t.match_ord = c.match_ord JOIN sets s ON s.stream_id = c.stream_id AND s.match_ord = c.match_ord),
greedy AS (SELECT stream_id, cluster, match_ord, k, ids AS used, true AS keep FROM ranked WHERE k = 1
  UNION ALL SELECT r.stream_id, r.cluster, r.match_ord, r.k, CASE WHEN list_has_any(g.used, r.ids) THEN g.used ELSE list_concat(g.used, r.ids) END, NOT list_has_any(g.used, r.ids) FROM greedy g JOIN ranked r ON r.stream_id = g.stream_id AND r.cluster = g.cluster AND r.k = g.k + 1)"""
)
_ISL = f"""tm AS (SELECT * FROM members JOIN segments USING (stream_id, idx)), ct AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) > {GAP} THEN 1 ELSE 0 END AS cut FROM tm),
isl AS (SELECT stream_id, match_ord * 1000 + sum(cut) OVER (PARTITION BY stream_id, match_ord ORDER BY idx)::BIGINT AS match_ord, title, confidence, idx FROM ct)"""


def _best_sql(left: str, right: str, name: str) -> str:
    return f"""{name}_c AS (SELECT a.stream_id, a.match_ord, b.match_ord AS o, count(*) AS shared, any_value(b.title) AS o_title, any_value(b.confidence) AS o_confidence FROM {left} a JOIN {right} b ON a.stream_id = b.stream_id AND a.idx = b.idx GROUP BY ALL),
{name} AS (SELECT * FROM {name}_c QUALIFY row_number() OVER (PARTITION BY stream_id, match_ord ORDER BY shared DESC, o_confidence DESC, o) = 1)"""


_EVAL = f"""{_ISL}, anchors AS (SELECT * FROM members WHERE confidence >= 0.6), ah AS ({_HEADS.format('anchors')}), {_best_sql('anchors', 'isl', 'best')},
found AS (SELECT ah.stream_id, count(*) AS anchors, count(*) FILTER (coalesce(shared, 0) >= 0.5 * ah.n) AS hits, count(*) FILTER (coalesce(shared, 0) >= 0.5 * ah.n AND lower(trim(title)) = lower(trim(o_title))) AS agreed FROM ah LEFT JOIN best b ON b.stream_id = ah.stream_id AND b.match_ord = ah.match_ord GROUP BY ALL),
pairs AS (SELECT stream_id, count(*) AS overlap_pairs FROM (SELECT DISTINCT a.stream_id, a.match_ord AS x, b.match_ord AS y FROM isl a JOIN isl b ON a.stream_id = b.stream_id AND a.idx = b.idx AND a.match_ord < b.match_ord) GROUP BY ALL),
l AS (SELECT DISTINCT stream_id, idx, 1 AS l FROM isl), r AS (SELECT DISTINCT stream_id, idx, 1 AS r FROM anchors),
cover AS (SELECT stream_id, count(*) FILTER (l = 1 AND r = 1) AS true_segments, count(*) FILTER (r IS NULL) AS extra_segments, count(*) FILTER (l IS NULL) AS missed_segments FROM l FULL JOIN r USING (stream_id, idx) GROUP BY ALL),
counts AS (SELECT stream_id, count(DISTINCT match_ord) AS matches FROM isl GROUP BY ALL),
ev AS (SELECT stream_id, matches, coalesce(anchors, 0) AS anchors, coalesce(hits, 0) AS hits, coalesce(agreed, 0) AS agreed, coalesce(overlap_pairs, 0) AS overlap_pairs, coalesce(true_segments, 0) AS true_segments, coalesce(extra_segments, 0) AS extra_segments, coalesce(missed_segments, 0) AS missed_segments,
  CASE WHEN true_segments + extra_segments > 0 THEN true_segments / (true_segments + extra_segments) END AS precision, CASE WHEN true_segments + missed_segments > 0 THEN true_segments / (true_segments + missed_segments) END AS recall
  FROM counts LEFT JOIN found USING (stream_id) LEFT JOIN pairs USING (stream_id) LEFT JOIN cover USING (stream_id))"""

_METRICS = f"""{_ISL}, cand AS (SELECT * FROM isl UNION ALL SELECT stream_id, match_ord + 500, title, confidence, idx FROM isl WHERE stream_id % 3 = 0 AND title = 'view'), anchors AS (SELECT * FROM members WHERE confidence >= 0.6), ah AS ({_HEADS.format('anchors')}), {_best_sql('anchors', 'cand', 'best')},
st AS (SELECT DISTINCT stream_id FROM segments), ch AS ({_HEADS.format('cand')}), cs AS (SELECT stream_id, match_ord, lower(trim(any_value(title))) AS key, list_sort(list_distinct(list(idx))) AS ids FROM cand GROUP BY ALL), p1 AS (SELECT stream_id, count(*) AS matches FROM ch GROUP BY ALL),
p2 AS (SELECT stream_id, sum(n - 1)::BIGINT AS dup FROM (SELECT stream_id, key, ids, count(*) AS n FROM cs GROUP BY ALL) GROUP BY ALL),
pr AS (SELECT DISTINCT a.stream_id, a.match_ord AS x, b.match_ord AS y, lower(trim(a.title)) = lower(trim(b.title)) AS same FROM cand a JOIN cand b ON a.stream_id = b.stream_id AND a.idx = b.idx AND a.match_ord < b.match_ord), p3 AS (SELECT stream_id, count(*) FILTER (NOT same) AS diff, count(*) FILTER (same) AS same FROM pr GROUP BY ALL),
p4 AS (SELECT ah.stream_id, count(*) AS anchors, count(*) FILTER (coalesce(shared, 0) >= 0.5 * ah.n) AS hits, count(*) FILTER (coalesce(shared, 0) >= 0.5 * ah.n AND lower(trim(title)) = lower(trim(o_title))) AS agreed FROM ah LEFT JOIN best b ON b.stream_id = ah.stream_id AND b.match_ord = ah.match_ord GROUP BY ALL),
mt AS (SELECT DISTINCT a.stream_id, a.match_ord AS anchor, lower(trim(a.title)) AS akey, c.match_ord FROM anchors a JOIN cand c ON a.stream_id = c.stream_id AND a.idx = c.idx), p5 AS (SELECT stream_id, count(*) FILTER (n > 1) AS frag FROM (SELECT stream_id, anchor, count(*) AS n FROM mt GROUP BY ALL) GROUP BY ALL),
p6 AS (SELECT stream_id, count(*) FILTER (n > 1) AS coal, count(*) FILTER (t > 1) AS mixed FROM (SELECT stream_id, match_ord, count(*) AS n, count(DISTINCT akey) AS t FROM mt GROUP BY ALL) GROUP BY ALL),
l AS (SELECT DISTINCT stream_id, idx, 1 AS l FROM cand), r AS (SELECT DISTINCT stream_id, idx, 1 AS r FROM anchors), p7 AS (SELECT stream_id, count(*) FILTER (l = 1 AND r = 1) AS bo, count(*) FILTER (r IS NULL) AS ol, count(*) FILTER (l IS NULL) AS onr FROM l FULL JOIN r USING (stream_id, idx) GROUP BY ALL),
du AS (SELECT h.stream_id, h.title, greatest(0, b.end_s - a.start_s) AS d FROM ch h JOIN segments a ON a.stream_id = h.stream_id AND a.idx = h.lo JOIN segments b ON b.stream_id = h.stream_id AND b.idx = h.hi), p8 AS (SELECT stream_id, count(*) FILTER (d < 150 OR d > 360) AS outl, count(*) FILTER (d > 360 AND title IN ('click', 'view')) AS regr, count(DISTINCT title) FILTER (title IN ('click', 'view')) AS prot FROM du GROUP BY ALL),
us AS (SELECT stream_id, sum(hit)::BIGINT AS hit, sum(miss)::BIGINT AS miss, sum(completion)::BIGINT AS comp FROM usage WHERE content_type = 'song' GROUP BY ALL), ub AS (SELECT stream_id, (sum(hit) * 0.0028::DOUBLE + sum(miss) * 0.14::DOUBLE + sum(completion) * 0.28::DOUBLE) / 1e6 AS base FROM usage GROUP BY ALL), pbase AS (SELECT stream_id, coalesce(base, 0) AS base FROM st LEFT JOIN ub USING (stream_id)),
pm0 AS (SELECT stream_id, coalesce(matches, 0) AS matches, 0::BIGINT AS unknown_titles, coalesce(dup, 0) AS exact_duplicates, coalesce(diff, 0) AS different_title_overlaps, coalesce(same, 0) AS same_title_overlaps, coalesce(anchors, 0) AS anchors, coalesce(hits, 0) AS anchor_hits, coalesce(agreed, 0) AS title_agreements, coalesce(frag, 0) AS fragmented_anchors,
  coalesce(coal, 0) AS coalesced_anchors, coalesce(mixed, 0) AS mixed_title_coalesced, coalesce(outl, 0) AS duration_outliers, coalesce(regr, 0) AS overlong_regressions, coalesce(prot, 0) AS protected_found, coalesce(matches, 0) AS known_titles, CASE WHEN anchors > 0 THEN hits / anchors END AS anchor_recall,
  CASE WHEN bo + ol > 0 THEN bo / (bo + ol) END AS coverage_precision, CASE WHEN bo + onr > 0 THEN bo / (bo + onr) END AS coverage_recall, CASE WHEN hit + miss > 0 THEN hit / (hit + miss) END AS cache_hit_ratio, coalesce((hit * 0.0028::DOUBLE + miss * 0.14::DOUBLE + comp * 0.28::DOUBLE) / 1e6, 0) AS cost_usd, (stream_id % 5) / 1000.0::DOUBLE AS estimated_usd
  FROM st LEFT JOIN p1 USING (stream_id) LEFT JOIN p2 USING (stream_id) LEFT JOIN p3 USING (stream_id) LEFT JOIN p4 USING (stream_id) LEFT JOIN p5 USING (stream_id) LEFT JOIN p6 USING (stream_id) LEFT JOIN p7 USING (stream_id) LEFT JOIN p8 USING (stream_id) LEFT JOIN us USING (stream_id)),
pm AS (SELECT *, CASE WHEN estimated_usd > 0 THEN abs(cost_usd - estimated_usd) / estimated_usd END AS estimate_error, CASE WHEN estimated_usd > 0 THEN abs(cost_usd - estimated_usd) / estimated_usd <= 0.15 END AS estimate_valid FROM pm0)"""

SQL = {
    "c4_merge_same_title": with_inputs(*_E, more=_merge_sql(False), body=_HEADS.format("merged")),
    "c5_merge_neighbours": with_inputs(*_E, more=_merge_sql(True), body=_HEADS.format("merged")),
    "u2_drop_duplicates": with_inputs(*_E, more="twice AS (SELECT stream_id, match_ord, title, confidence, idx FROM members UNION ALL SELECT stream_id, match_ord + 10000, title, confidence, idx FROM members WHERE match_ord % 3 = 0), sets AS (SELECT stream_id, match_ord, lower(trim(any_value(title))) AS key, list_sort(list_distinct(list(idx))) AS ids FROM twice GROUP BY ALL), firsts AS (SELECT stream_id, min(match_ord) AS match_ord FROM sets GROUP BY stream_id, key, ids)", body="SELECT twice.* FROM twice SEMI JOIN firsts USING (stream_id, match_ord)"),
    "a1_measures": with_inputs(*_E, more=_MEASURES, body="SELECT stream_id, match_ord, title, confidence, lo, hi, n, lo_s, hi_s, duration_s, speech_s, max_gap_s FROM measures"),
    "c10_risks": with_inputs(*_E, more=_RISKS, body="""SELECT stream_id, match_ord, title, duration_s, duration, boundary, overlap, evidence, score,
CASE WHEN score >= 0.9 THEN 'review_requires_evidence' WHEN short OR long OR far IS NOT NULL OR boundary >= 0.75 OR score >= 0.55 OR overlap > 0 THEN 'review' ELSE 'accept' END AS action,
list_filter([CASE WHEN short THEN 'duration_below_soft_range' END, CASE WHEN long THEN 'duration_above_soft_range' END, CASE WHEN boundary >= 0.5 THEN 'sparse_or_expanded_boundary' END, CASE WHEN far IS NOT NULL THEN 'distant_same_title' END, CASE WHEN stop IS NOT NULL THEN 'different_title_overlap' END, CASE WHEN unk THEN 'unknown_title' END, CASE WHEN NOT unk THEN 'title_without_lyric_evidence' END, CASE WHEN score >= 0.9 THEN 'high_risk_requires_evidence' END], lambda x: x IS NOT NULL) AS reasons FROM scored"""),
    "c12_conflict_edges": with_inputs(*_E, more=_EDGES.format(near=_NEAR), body="SELECT * FROM edges"),
    "c12_clusters": with_inputs(*_E, more=_CLUSTERS, body="SELECT * FROM clusters"),
    "c13_select_best": with_inputs(*_E, more=_SELECT, body="SELECT stream_id, match_ord, cluster, CASE WHEN keep THEN 'keep' ELSE 'discard' END AS action FROM greedy"),
    "j10_best_overlap": with_inputs(*_E, more=_ISL + ", " + _best_sql("isl", "members", "best"), body="SELECT * FROM best"),
    "c23_restore_titles": with_inputs(*_E, more=_ISL + ", temporal AS (SELECT stream_id, match_ord, CASE WHEN match_ord % 4 = 0 THEN '未知歌曲：x' WHEN match_ord % 6 = 0 THEN 'view' ELSE title END AS title, confidence, idx FROM members WHERE match_ord % 2 = 0), " + _best_sql("temporal", "isl", "best") + f""", th AS ({_HEADS.format('temporal')}), ih AS ({_HEADS.format('isl')}),
decided AS (SELECT th.stream_id, th.match_ord, title, confidence, o_title, o_confidence, CASE WHEN title NOT LIKE '未知歌曲%' AND o_title IS NOT NULL THEN CASE WHEN title = o_title THEN 'consistent' ELSE 'conflict' END WHEN title NOT LIKE '未知歌曲%' THEN 'temporal_only' WHEN o_title IS NULL THEN 'new' ELSE 'restored' END AS decision FROM th LEFT JOIN best b ON b.stream_id = th.stream_id AND b.match_ord = th.match_ord),
touched AS (SELECT DISTINCT i.stream_id, i.match_ord FROM isl i SEMI JOIN temporal t ON t.stream_id = i.stream_id AND t.idx = i.idx)""", body="""SELECT stream_id, 'temporal' AS origin, match_ord, CASE WHEN decision = 'new' THEN '未知歌曲：时序裁决新增区间' WHEN decision IN ('restored', 'conflict') THEN o_title ELSE title END AS title, CASE WHEN decision IN ('temporal_only', 'new') THEN confidence ELSE greatest(confidence, o_confidence) END AS confidence, decision FROM decided
UNION ALL SELECT stream_id, 'source', match_ord, title, confidence, 'appended' FROM ih ANTI JOIN touched USING (stream_id, match_ord) WHERE confidence >= 0.65"""),
    "c22_split_at_sources": with_inputs(*_E, more="""wide AS (SELECT DISTINCT stream_id, idx // 12 AS match_ord, idx FROM members), t AS (SELECT stream_id, match_ord, min(idx) AS lo, max(idx) AS hi FROM wide GROUP BY ALL),
src AS (SELECT stream_id, idx // 3 AS o, idx FROM segments), sh AS (SELECT stream_id, o, 't' || (o % 2) AS key, min(idx) AS slo, max(idx) AS shi, count(*) AS sn FROM src GROUP BY ALL),
cn AS (SELECT w.stream_id, w.match_ord, s.o, count(*) AS shared FROM wide w JOIN src s ON s.stream_id = w.stream_id AND s.idx = w.idx GROUP BY ALL),
sup AS (SELECT c.stream_id, c.match_ord, c.o, key, slo, shi, lead(slo) OVER w AS nxt, row_number() OVER w AS k FROM cn c JOIN sh ON sh.stream_id = c.stream_id AND sh.o = c.o WHERE shared * 2 >= sn WINDOW w AS (PARTITION BY c.stream_id, c.match_ord ORDER BY slo, c.o)),
ok AS (SELECT stream_id, match_ord FROM sup GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT key) >= 2 AND bool_and(nxt IS NULL OR shi < nxt)),
cut AS (SELECT *, (shi + nxt) // 2 AS e FROM sup SEMI JOIN ok USING (stream_id, match_ord)),
p AS (SELECT c.stream_id, c.match_ord, k AS part, greatest(lo, coalesce(lag(e) OVER (PARTITION BY c.stream_id, c.match_ord ORDER BY k) + 1, lo)) AS lo, least(hi, coalesce(e, hi)) AS hi FROM cut c JOIN t ON t.stream_id = c.stream_id AND t.match_ord = c.match_ord)""", body="SELECT * FROM p WHERE lo <= hi UNION ALL SELECT stream_id, match_ord, 1, lo, hi FROM t ANTI JOIN ok USING (stream_id, match_ord)"),
    "a7_evaluate": with_inputs(*_E, more=_EVAL, body="SELECT * FROM ev"),
    "a7_profile_metrics": with_inputs(*_E, "usage", more=_METRICS, body="SELECT * FROM pm"),
    "a9_gates": with_inputs(*_E, "usage", more=_METRICS, body="""SELECT stream_id, base > 0 AND cost_usd <= base * 0.9 AS cost_at_most_90_percent_of_accuracy, coalesce(coverage_precision >= 0.8, false) AS temporal_coverage_precision_at_least_80_percent, coalesce(coverage_recall >= 0.9, false) AS temporal_coverage_recall_at_least_90_percent,
overlong_regressions = 0 AS no_fixture_overlong_regressions, exact_duplicates = 0 AS no_exact_duplicates, different_title_overlaps = 0 AS no_different_title_overlap, same_title_overlaps = 0 AS no_same_title_overlap,
base > 0 AND cost_usd <= base * 0.9 AND coalesce(coverage_precision >= 0.8, false) AND coalesce(coverage_recall >= 0.9, false) AND overlong_regressions = 0 AND exact_duplicates = 0 AND different_title_overlaps = 0 AND same_title_overlaps = 0 AS passes_all_gates FROM pm JOIN pbase USING (stream_id)"""),
}
