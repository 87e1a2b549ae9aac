"""Queries of usage, cost and media operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import costs as co, intervals as iv, matches as mt, media, usage as us
from spanloom.plans.inputs import members, segments, table, usage, with_inputs
from spanloom.sources.checkpoints import cut, dealt

_E = ("segments", "members")


def _rare(spark, d):
    return members(spark, d).where(F.col("title").isin("click", "purchase"))


def q_totals(spark, d):
    return us.totals(usage(spark, d), ["stream_id", "phase"])


def q_report(spark, d):
    return us.report(usage(spark, d))


def q_profiles(spark, d):
    return us.profile_compare(usage(spark, d), "phase")


def q_calibration(spark, d):
    u = us.totals(usage(spark, d), ["phase"])
    guess = u.where("phase <> 'main'").withColumn("cost_usd", F.col("cost_usd") * F.when(F.col("phase") == "review", 1.1).otherwise(1.5))
    return us.calibration(guess, u)


def _features(spark, d):
    s, m = segments(spark, d), members(spark, d)
    h = mt.heads(m).where("confidence < 0.3").select("stream_id", F.col("match_ord").alias("cluster"))
    return us.stream_features(s, m, iv.uncovered(s, _rare(spark, d), 1), h)


def q_features(spark, d):
    return _features(spark, d)


def q_estimates(spark, d):
    return us.estimates(_features(spark, d))


def q_heuristic(spark, d):
    return us.heuristic(_features(spark, d)).select("stream_id", "scope", "strategy")


def q_pairwise(spark, d):
    e = us.estimates(_features(spark, d))
    cheap = F.least("review_local_usd", "review_full_usd")
    name = F.when(F.col("review_local_usd") <= F.col("review_full_usd"), us.choose(cheap, F.col("review_full_usd"), "local", "full", 0.1)).otherwise(us.choose(cheap, F.col("review_local_usd"), "full", "full", 0.1))
    return e.select("stream_id", name.alias("scope"))


def q_joint(spark, d):
    return us.joint_choice(us.estimates(_features(spark, d)))


COSTS = co.Rules(lines=20, template_chars=300, context=1, most_window=12, pack=12, gap_s=86400.0, cap_s=432000.0, most_segments=150, penalty=0.5, margin=0.02)


def _costs(spark, d):
    s, m = cut(segments(spark, d)), cut(members(spark, d).where("title <> 'purchase'"))
    weak = mt.heads(m).where("confidence < 0.3").select("stream_id", "match_ord", F.floor(F.col("match_ord") / 3).alias("cluster"))
    return co.stage_costs(s, m, weak, iv.uncovered(s, m, 2), COSTS)


def q_stage_costs(spark, d):
    return _costs(spark, d)


def q_five_costs(spark, d):
    return co.joint_choice(_costs(spark, d), COSTS)


def q_storm(spark, d):
    return us.storm(members(spark, d), segments(spark, d), least=50, per_hour=0.01, share=0.9)


def parts(spark, d):
    """A folder for each customer, a part for each line of their orders; every eleventh duration is unknown."""
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    return rows.select(
        F.col("o_custkey").alias("folder"), (F.row_number().over(order) - 1).cast("long").alias("part_idx"), F.when(F.col("l_orderkey") % 211 != 0, F.col("l_quantity") * 60.0).cast("double").alias("duration_s"),
        F.when(F.col("l_returnflag") == "A", "av1").otherwise("h264").alias("codec"), F.when(F.col("l_linenumber") > 2, 1280).otherwise(1920).cast("long").alias("width"), F.lit(1080).cast("long").alias("height"),
        F.when(F.col("l_linenumber") == 7, 25.0).otherwise(30.0).alias("fps"), (F.col("l_orderkey") % 13 != 0).alias("probe_ok"),
    )


def q_consistency(spark, d):
    return media.consistency(parts(spark, d))


def q_conformance(spark, d):
    p = parts(spark, d)
    return media.conformance(p, media.consistency(p))


def q_corrupt(spark, d):
    p = parts(spark, d)
    return media.corrupt_share(p, p.where("part_idx % 5 = 1"))


def q_recovery(spark, d):
    p = dealt(parts(spark, d), "folder")
    return dealt(media.recovery(p, p.where("part_idx % 5 = 1 and folder % 2 = 0")), "folder")


def q_boundary(spark, d):
    p = parts(spark, d)
    seen = p.where("part_idx < 4").groupBy("folder").agg((F.sum("duration_s") + 1.0).alias("observed_s"))
    return media.boundary_parts(p, seen)


def q_duration_ok(spark, d):
    c = media.consistency(parts(spark, d)).where("expected_s is not null")
    return media.duration_ok(c.select("folder", "expected_s", (F.col("expected_s") + F.col("folder") % 61).alias("actual_s")))


def q_scan(spark, d):
    return media.scan_plan(parts(spark, d), short_s=600.0)


QUERIES = {
    "m2_stage_costs": q_stage_costs, "m5_five_costs": q_five_costs,
    "a4_a5_usage_totals": q_totals, "a6_usage_report": q_report, "a8_k5_profile_compare": q_profiles, "a11_calibration": q_calibration, "a3_stream_features": q_features, "m1_m2_estimates": q_estimates,
    "m3_heuristic": q_heuristic, "m4_pairwise_choice": q_pairwise, "m5_joint_choice": q_joint, "a20_storm": q_storm, "a13_a15_consistency": q_consistency, "a16_conformance": q_conformance,
    "a17_corrupt_share": q_corrupt, "a21_recovery": q_recovery, "w8_boundary_parts": q_boundary, "a15_duration_ok": q_duration_ok, "a19_scan_plan": q_scan,
}

_P = "hit * 0.0028::DOUBLE / 1e6::DOUBLE + miss * 0.14::DOUBLE / 1e6::DOUBLE + completion * 0.28::DOUBLE / 1e6::DOUBLE"
_SUMS = "count(*) AS calls, sum(hit)::BIGINT AS hit, sum(miss)::BIGINT AS miss, sum(completion)::BIGINT AS completion"
_R = "CASE WHEN hit + miss > 0 THEN hit / (hit + miss) END AS hit_ratio"
_PHASES = f"t AS (SELECT phase, {_SUMS} FROM usage GROUP BY ALL), p AS (SELECT *, {_R}, {_P} AS cost_usd FROM t)"
_FEATURES = """rare AS (SELECT * FROM members WHERE title IN ('click', 'purchase')), free AS (SELECT stream_id, idx FROM segments ANTI JOIN rare USING (stream_id, idx)),
g AS (SELECT stream_id, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS run FROM free), tg AS (SELECT stream_id, count(DISTINCT run) AS targets FROM g GROUP BY ALL),
b AS (SELECT stream_id, count(*) AS segments, sum(length(text))::BIGINT AS chars, max(end_s) - min(start_s) AS seconds FROM segments GROUP BY ALL), m AS (SELECT stream_id, count(DISTINCT match_ord) AS matches, count(DISTINCT match_ord) FILTER (confidence < 0.3) AS clusters FROM members GROUP BY ALL),
features AS (SELECT b.*, coalesce(matches, 0) AS matches, coalesce(targets, 0) AS targets, coalesce(clusters, 0) AS clusters FROM b LEFT JOIN m USING (stream_id) LEFT JOIN tg USING (stream_id))"""


def _pr(hit: str, miss: str, out: str) -> str:
    return f"({hit}) * 0.0028::DOUBLE / 1e6::DOUBLE + ({miss}) * 0.14::DOUBLE / 1e6::DOUBLE + ({out}) * 0.28::DOUBLE / 1e6::DOUBLE"


_EST = (
    _FEATURES
    + f""", x AS (SELECT *, greatest(1, floor(chars * 0.62::DOUBLE)::BIGINT) AS text, 248 AS tpl, ceil(segments / 20)::BIGINT AS calls, least(clusters, 1) AS c1, least(targets, 1) AS t1 FROM features),
est AS (SELECT stream_id, segments, chars, seconds, matches, targets, clusters, {_pr('0', 'text + tpl * calls', 'calls * 720')} AS main_usd, {_pr('0', 'clusters * (text / calls + tpl)', 'clusters * 420')} AS review_local_usd, CASE WHEN c1 > 0 THEN {_pr('text * c1', 'tpl * c1', 'c1 * 420')} ELSE 0 END AS review_full_usd,
{_pr('0', 'targets * (text / calls + tpl)', 'targets * 360')} AS missed_windowed_usd, CASE WHEN t1 > 0 THEN {_pr('text * t1', 'tpl * t1', 't1 * 1100')} ELSE 0 END AS missed_full_usd FROM x)"""
)
_PARTS = """parts AS (SELECT o_custkey AS folder, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 AS part_idx, CASE WHEN l_orderkey % 211 <> 0 THEN l_quantity * 60.0 END::DOUBLE AS duration_s,
CASE WHEN l_returnflag = 'A' THEN 'av1' ELSE 'h264' END AS codec, CASE WHEN l_linenumber > 2 THEN 1280 ELSE 1920 END::BIGINT AS width, 1080::BIGINT AS height, CASE WHEN l_linenumber = 7 THEN 25.0 ELSE 30.0 END::DOUBLE AS fps, l_orderkey % 13 <> 0 AS probe_ok FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
cons AS (SELECT folder, count(*) AS parts, bool_and(probe_ok) AND count(DISTINCT codec) <= 1 AND count(DISTINCT width) <= 1 AND count(DISTINCT height) <= 1 AND count(DISTINCT fps) <= 1 AS direct_copy, CASE WHEN count(*) = count(duration_s) THEN sum(duration_s) END AS expected_s,
min(row(width * height, part_idx, width, height))[3] AS target_width, min(row(width * height, part_idx, width, height))[4] AS target_height, min(round(fps, 3)) AS target_fps FROM parts GROUP BY ALL),
conf AS (SELECT folder, part_idx, width = target_width AND height = target_height AND abs(fps - target_fps) < 0.01 AS conforms FROM parts JOIN cons USING (folder))"""
_BAD = "bad AS (SELECT folder, CASE WHEN count(*) = count(duration_s) THEN coalesce(sum(duration_s) FILTER ({0}), 0) END AS bad_s, CASE WHEN count(*) = count(duration_s) THEN coalesce(sum(duration_s) FILTER ({0}), 0) / sum(duration_s) END AS bad_share, count(*) FILTER ({0}) AS bad_parts, count(*) AS parts FROM parts GROUP BY ALL)"

_TPL, _PR = 300, "({0} * 0.0028::DOUBLE + {1} * 0.14::DOUBLE + {2} * 0.28::DOUBLE) / 1e6"


def _tok(chars: str) -> str:
    return f"greatest(1, floor(({chars}) * 0.62::DOUBLE))"


_COSTS = f"""lone AS (SELECT * FROM members WHERE title <> 'purchase'), ln AS (SELECT stream_id, idx, sum(length(printf('[%d] (%.1f-%.1f) %s', idx, start_s, end_s, text)) + 1) OVER (PARTITION BY stream_id ORDER BY idx)::BIGINT AS c FROM segments),
sz AS (SELECT stream_id, count(*) AS segments, max(c) AS whole, max(idx) AS t FROM ln GROUP BY ALL),
bt AS (SELECT stream_id, 'main' AS kind, min(idx) AS lo, max(idx) AS hi FROM segments GROUP BY stream_id, idx // 20),
lt AS (SELECT m.*, start_s, end_s, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) > 86400 THEN 1 ELSE 0 END AS cut FROM lone m JOIN segments USING (stream_id, idx)), lp AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) AS part FROM lt),
lg AS (SELECT stream_id, min(idx) AS lo, max(idx) AS hi FROM lp GROUP BY stream_id, match_ord, part HAVING arg_max(end_s, idx) - arg_min(start_s, idx) > 432000),
wk AS (SELECT stream_id, match_ord // 3 AS cluster, min(lo) AS lo, max(hi) AS hi FROM (SELECT stream_id, match_ord, min(idx) AS lo, max(idx) AS hi, any_value(confidence) AS c FROM lone GROUP BY ALL) WHERE c < 0.3 GROUP BY ALL HAVING max(hi) - min(lo) + 1 <= 12),
uf AS (SELECT stream_id, idx FROM segments ANTI JOIN lone USING (stream_id, idx)), ur AS (SELECT *, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS run FROM uf), tg AS (SELECT stream_id, min(idx) AS lo, max(idx) AS hi FROM ur GROUP BY stream_id, run HAVING count(*) >= 2), tk AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY lo, hi) AS k FROM tg),
pk AS (SELECT stream_id, k, lo, hi, lo AS begin, 0::BIGINT AS w FROM tk WHERE k = 1 UNION ALL SELECT x.stream_id, x.k, x.lo, x.hi, CASE WHEN x.hi - f.begin + 1 <= 12 THEN f.begin ELSE x.lo END, CASE WHEN x.hi - f.begin + 1 <= 12 THEN f.w ELSE f.w + 1 END FROM pk f JOIN tk x ON x.stream_id = f.stream_id AND x.k = f.k + 1),
wn AS (SELECT stream_id, min(lo) AS lo, max(hi) AS hi FROM pk GROUP BY stream_id, w), lw AS (SELECT w.* FROM wk w ANTI JOIN tg g ON g.stream_id = w.stream_id AND w.lo >= g.lo AND w.hi <= g.hi),
rq AS (SELECT stream_id, kind, lo, hi FROM bt UNION ALL SELECT stream_id, kind, greatest(0, lo - 1), least(t, hi + 1) FROM (SELECT stream_id, 'overlong' AS kind, lo, hi FROM lg UNION ALL SELECT stream_id, 'local', lo, hi FROM wk UNION ALL SELECT stream_id, 'late', lo, hi FROM lw UNION ALL SELECT stream_id, 'window', lo, hi FROM wn) JOIN sz USING (stream_id)),
rc AS (SELECT q.stream_id, kind, sum({_PR.format('0', _tok(f'a.c - coalesce(b.c, 0) + {_TPL}'), "CASE kind WHEN 'main' THEN 720 WHEN 'overlong' THEN 360 WHEN 'window' THEN 360 ELSE 420 END")}) AS usd FROM rq q JOIN ln a ON a.stream_id = q.stream_id AND a.idx = q.hi LEFT JOIN ln b ON b.stream_id = q.stream_id AND b.idx = q.lo - 1 GROUP BY ALL),
rw AS (SELECT stream_id, sum(usd) FILTER (kind = 'main') AS main, sum(usd) FILTER (kind = 'overlong') AS long, sum(usd) FILTER (kind = 'local') AS local, sum(usd) FILTER (kind = 'late') AS late, sum(usd) FILTER (kind = 'window') AS win FROM rc GROUP BY ALL),
fl AS (SELECT w.stream_id, count(*) * {_PR.format(_tok('any_value(whole)'), _tok(str(_TPL)), '420')} AS usd FROM wk w JOIN sz USING (stream_id) GROUP BY w.stream_id), ll AS (SELECT w.stream_id, count(*) * {_PR.format(_tok('any_value(whole)'), _tok(str(_TPL)), '420')} AS usd FROM lw w JOIN sz USING (stream_id) GROUP BY w.stream_id),
au AS (SELECT stream_id, {_PR.format(_tok('whole'), _tok(str(_TPL)), '1100')} AS usd FROM sz SEMI JOIN tg USING (stream_id)),
cs AS (SELECT sz.stream_id, segments, coalesce(main, 0)::DOUBLE AS main_usd, coalesce(long, 0)::DOUBLE AS overlong_usd, coalesce(local, 0)::DOUBLE AS review_local_usd, coalesce(fl.usd, 0)::DOUBLE AS review_full_usd, coalesce(win, 0)::DOUBLE AS missed_windowed_usd, coalesce(au.usd, 0) + CASE WHEN segments > 150 THEN coalesce(win, 0) * 0.5 ELSE 0 END::DOUBLE AS missed_full_transcript_usd,
  coalesce(local, 0)::DOUBLE AS after_local_windowed_usd, coalesce(fl.usd, 0)::DOUBLE AS after_full_windowed_usd, coalesce(late, 0)::DOUBLE AS after_local_full_transcript_usd, coalesce(ll.usd, 0)::DOUBLE AS after_full_full_transcript_usd
  FROM sz LEFT JOIN rw ON rw.stream_id = sz.stream_id LEFT JOIN fl ON fl.stream_id = sz.stream_id LEFT JOIN ll ON ll.stream_id = sz.stream_id LEFT JOIN au ON au.stream_id = sz.stream_id),
op AS (SELECT stream_id, unnest([row(main_usd + review_local_usd + overlong_usd + missed_windowed_usd + after_local_windowed_usd, 0, 'local', 'windowed'), row(main_usd + review_local_usd + overlong_usd + missed_full_transcript_usd + after_local_full_transcript_usd, 1, 'local', 'full_transcript'),
  row(main_usd + review_full_usd + overlong_usd + missed_windowed_usd + after_full_windowed_usd, 2, 'full', 'windowed'), row(main_usd + review_full_usd + overlong_usd + missed_full_transcript_usd + after_full_full_transcript_usd, 3, 'full', 'full_transcript')]) AS o FROM cs),
pc AS (SELECT stream_id, min(o) AS b, min(o) FILTER (o[2] = 0) AS s FROM op GROUP BY ALL), pd AS (SELECT *, (s[1] - b[1]) / greatest(s[1], b[1], 1e-9) < 0.02 AS near FROM pc)"""

SQL = {
    "m2_stage_costs": with_inputs(*_E, more=_COSTS, body="SELECT * FROM cs"),
    "m5_five_costs": with_inputs(*_E, more=_COSTS, body="SELECT stream_id, CASE WHEN near THEN s[3] ELSE b[3] END AS scope, CASE WHEN near THEN s[4] ELSE b[4] END AS strategy, CASE WHEN near THEN s[1] ELSE b[1] END AS usd, CASE WHEN b[2] = 0 OR NOT near THEN 'cheapest' ELSE 'within_margin' END AS reason FROM pd"),
    "a4_a5_usage_totals": with_inputs("usage", more=f"t AS (SELECT stream_id, phase, {_SUMS} FROM usage GROUP BY ALL)", body=f"SELECT *, {_R}, {_P} AS cost_usd FROM t"),
    "a6_usage_report": with_inputs("usage", more=f"t AS (SELECT phase, content_type, {_SUMS} FROM usage GROUP BY GROUPING SETS ((phase), (content_type), ()))", body=f"SELECT *, {_R} FROM t"),
    "a8_k5_profile_compare": with_inputs("usage", more=_PHASES, body="SELECT *, cost_usd / min(cost_usd) OVER () AS against_best FROM p"),
    "a11_calibration": with_inputs("usage", more=_PHASES + ", c AS (SELECT phase, CASE phase WHEN 'main' THEN NULL WHEN 'review' THEN cost_usd * 1.1::DOUBLE ELSE cost_usd * 1.5::DOUBLE END AS estimated, cost_usd AS actual FROM p)", body="SELECT *, abs(coalesce(estimated, 0) - actual) / actual AS error, abs(coalesce(estimated, 0) - actual) / actual <= 0.15 AS valid FROM c"),
    "a3_stream_features": with_inputs(*_E, more=_FEATURES, body="SELECT * FROM features"),
    "m1_m2_estimates": with_inputs(*_E, more=_EST, body="SELECT * FROM est"),
    "m3_heuristic": with_inputs(*_E, more=_FEATURES, body="SELECT stream_id, CASE WHEN segments > 3500 OR clusters <= 3 THEN 'local' ELSE 'full' END AS scope, CASE WHEN segments > 3500 OR targets < 19 THEN 'windowed' ELSE 'full' END AS strategy FROM features"),
    "m4_pairwise_choice": with_inputs(*_E, more=_EST, body="SELECT stream_id, CASE WHEN review_local_usd <= review_full_usd AND NOT abs(review_local_usd - review_full_usd) / greatest(review_local_usd, review_full_usd, 1e-9) < 0.1 THEN 'local' ELSE 'full' END AS scope FROM est"),
    "m5_joint_choice": with_inputs(*_E, more=_EST + ", o AS (SELECT stream_id, unnest([0, 1, 2, 3]) AS k, unnest(['local', 'local', 'full', 'full']) AS scope, unnest(['windowed', 'full', 'windowed', 'full']) AS strategy, unnest([main_usd + review_local_usd + missed_windowed_usd, main_usd + review_local_usd + missed_full_usd, main_usd + review_full_usd + missed_windowed_usd, main_usd + review_full_usd + missed_full_usd]) AS usd FROM est), w AS (SELECT stream_id, min(row(usd, k, scope, strategy)) AS b, max(usd) FILTER (k = 0) AS first FROM o GROUP BY ALL)", body="SELECT stream_id, CASE WHEN abs(b[1] - first) / greatest(b[1], first, 1e-9) < 0.1 THEN 'local' ELSE b[3] END AS scope, CASE WHEN abs(b[1] - first) / greatest(b[1], first, 1e-9) < 0.1 THEN 'windowed' ELSE b[4] END AS strategy, CASE WHEN abs(b[1] - first) / greatest(b[1], first, 1e-9) < 0.1 THEN first ELSE b[1] END AS usd FROM w"),
    "a20_storm": with_inputs(*_E, more="h AS (SELECT stream_id, greatest(1 / 60, (arg_max(end_s, idx) - arg_min(start_s, idx)) / 3600) AS hours FROM segments GROUP BY ALL), c AS (SELECT stream_id, match_ord, count(*) AS n FROM members GROUP BY ALL), s AS (SELECT stream_id, count(*) AS candidates, count(*) FILTER (n <= 2) AS short FROM c GROUP BY ALL)", body="SELECT stream_id, candidates, short, candidates > greatest(50, ceil(hours * 0.01::DOUBLE)) AND short / candidates >= 0.9 AS storm FROM s JOIN h USING (stream_id)"),
    "a13_a15_consistency": f"WITH {_PARTS} SELECT * FROM cons",
    "a16_conformance": f"WITH {_PARTS} SELECT * FROM conf",
    "a17_corrupt_share": f"WITH {_PARTS}, {_BAD.format('part_idx % 5 = 1')} SELECT * FROM bad",
    "a21_recovery": f"WITH {_PARTS}, {_BAD.format('part_idx % 5 = 1 AND folder % 2 = 0')}, odd AS (SELECT folder, count(*) FILTER (NOT conforms) AS odd_parts FROM conf GROUP BY ALL) SELECT folder, direct_copy, bad_parts, odd_parts, CASE WHEN direct_copy AND bad_parts = 0 THEN 'direct_copy' WHEN bad_parts > 0 AND coalesce(bad_share, bad_parts / bad.parts) <= 0.5 THEN 'targeted_repair' ELSE 'normalise' END AS strategy FROM cons JOIN bad USING (folder) JOIN odd USING (folder)",
    "w8_boundary_parts": f"WITH {_PARTS}, seen AS (SELECT folder, sum(duration_s) + 1.0 AS observed_s FROM parts WHERE part_idx < 4 GROUP BY ALL), run AS (SELECT *, sum(duration_s) OVER (PARTITION BY folder ORDER BY part_idx) AS run, sum(duration_s) OVER (PARTITION BY folder) AS total, count(*) FILTER (duration_s IS NULL) OVER (PARTITION BY folder ORDER BY part_idx) AS unk FROM parts), hit AS (SELECT folder, min(part_idx) AS p FROM run JOIN seen USING (folder) WHERE unk = 0 AND abs(run - observed_s) <= greatest(2.0, total * 0.0005) GROUP BY ALL) SELECT folder, part_idx FROM parts JOIN hit USING (folder) WHERE abs(part_idx - p) <= 1",
    "a15_duration_ok": f"WITH {_PARTS} SELECT folder, expected_s, expected_s + folder % 61 AS actual_s, folder % 61 <= greatest(30.0, expected_s * 0.005) AS ok FROM cons WHERE expected_s IS NOT NULL",
    "a19_scan_plan": f"WITH {_PARTS} SELECT folder, part_idx, CASE WHEN codec <> 'h264' THEN 'none' WHEN duration_s < 600 THEN 'full' ELSE 'tail' END AS scan FROM parts",
}
