"""Queries of the three-round protocol and of response parsing, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import intervals as iv, matches as mt, protocol as pr, responses as rs
from spanloom.plans.inputs import both, members, segments, with_inputs
from spanloom.sources.checkpoints import dealt

_E = ("segments", "members")


def _rare(spark, d):
    return members(spark, d).where(F.col("title").isin("click", "purchase"))


def raw_ranges(rows):
    """Candidate ranges as an annotator gives them: every fourth object repeats the one before, some run past the end."""
    runs = iv.index_ranges(rows.where(F.col("title").isin("click", "purchase")), ["stream_id", "match_ord"])
    own = runs.select("stream_id", (F.col("match_ord") * 2).alias("obj"), F.col("lo"), F.when(F.col("match_ord") % 9 == 0, F.col("hi") + 1000).otherwise(F.col("hi")).alias("hi"), F.lit(0.8).alias("confidence"), F.concat(F.lit(" a"), F.col("match_ord")).alias("anchor"))
    return own.union(own.where("obj % 4 = 0").withColumn("obj", F.col("obj") + 1))


def _raw(spark, d):
    return raw_ranges(members(spark, d))


def q_discovery(spark, d):
    c = pr.discovery(_raw(spark, d), segments(spark, d))
    return c.select("stream_id", "obj", "id", "anchor", "confidence", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["lo"], r["hi"])), ",").alias("ranges"))


def q_discovery_reason(spark, d):
    r = segments(spark, d).select("stream_id").distinct().select("stream_id", (F.col("stream_id") % 7 != 0).alias("complete"), (F.col("stream_id") % 3).alias("raw_objects"))
    return pr.discovery_reason(r, pr.discovery(_raw(spark, d).where("stream_id % 2 = 0"), segments(spark, d)))


def _targets(spark, d):
    return pr.recall_targets(segments(spark, d), _rare(spark, d), 0)


def q_targets(spark, d):
    return _targets(spark, d)


def _anchors(spark, d):
    t = _targets(spark, d).withColumn("obj", F.floor(F.col("lo") / 2) + F.col("stream_id") % 2)
    return t.select("stream_id", "obj", F.when(F.col("lo") % 10 == 9, "U999").otherwise(F.col("target")).alias("target"), (F.col("lo") - F.col("obj") % 2).alias("lo"), (F.col("hi") + F.col("obj") % 2).alias("hi"), F.lit(0.7).alias("confidence"))


def q_anchors(spark, d):
    return pr.recall_anchors(_anchors(spark, d), _targets(spark, d))


def q_recall_reason(spark, d):
    return pr.recall_reason(_anchors(spark, d), _targets(spark, d))


def _candidates(spark, d):
    return _candidates_of(members(spark, d), segments(spark, d))


def _candidates_of(rows, segs):
    c = pr.discovery(raw_ranges(rows), segs)
    return c.select("stream_id", "id", F.when(F.col("obj") % 3 == 0, "").otherwise(F.col("anchor")).alias("anchor"), F.get("ranges", 0)["lo"].alias("lo"), F.get("ranges", 0)["hi"].alias("hi"))


def _decisions(spark, d):
    return _decisions_of(_candidates(spark, d))


def _decisions_of(candidates):
    """One decision for each candidate, by turns; some streams break a rule."""
    c = candidates.withColumn("dec", F.substring("id", 2, 9).cast("long")).withColumn("s", F.col("stream_id") % 6)
    action = F.when((F.col("s") == 1) & (F.col("dec") == 3), "guess").when(F.col("dec") % 5 == 0, "reject").otherwise("accept")
    ident = F.when((F.col("s") == 2) & (F.col("dec") == 2), "P998").when((F.col("s") == 3) & (F.col("dec") == 4), "P001").otherwise(F.col("id"))
    bare = ((F.col("dec") % 5 == 0) & (F.col("s") != 4)) | ((F.col("s") == 5) & (F.col("dec") == 1))
    rows = c.where("not (stream_id % 12 = 0 and dec = 6)")
    return rows.select("stream_id", "dec", action.alias("action"), ident.alias("id"), F.when(~bare, F.col("lo")).alias("lo"), F.when(~bare, F.col("hi")).alias("hi"), F.lit(0.9).alias("confidence"))


def q_adjudication_reason(spark, d):
    return pr.adjudication_reason(_decisions(spark, d), _candidates(spark, d))


def q_apply(spark, d):
    return mt.heads(pr.apply_decisions(_decisions(spark, d), _candidates(spark, d)))


def _additions(spark, d):
    return _additions_of(_targets(spark, d))


def _additions_of(targets):
    """Additions in uncovered ranges, six segments to each; in odd streams a range's evidence is its first segment alone."""
    t = targets.select("stream_id", F.floor(F.col("lo") / 6).alias("add"), "lo", "hi", (F.col("stream_id") % 5 != 0).alias("final_discovery"), F.lit(0.7).alias("confidence"))
    t = t.withColumn("anchor", F.when(F.col("add") % 2 == 0, F.concat(F.lit(" t"), "add")))
    shown = F.when(F.col("stream_id") % 2 == 0, F.least(F.col("lo") + 1, "hi")).otherwise(F.col("lo"))
    return t.withColumn("kind", F.lit("final")).unionByName(t.withColumn("hi", shown).withColumn("kind", F.lit("evidence")))


def q_additions_reason(spark, d):
    rows, segs = both(spark, d)
    candidates = dealt(_candidates_of(rows, segs))
    targets = dealt(pr.recall_targets(segs, rows.where(F.col("title").isin("click", "purchase")), 0))
    complete = segs.select("stream_id").distinct().withColumn("complete", F.col("stream_id") % 13 != 0)
    return dealt(pr.adjudication_reason(_decisions_of(candidates), candidates, _additions_of(targets), segs, complete))


def q_apply_additions(spark, d):
    return mt.heads(pr.apply_decisions(_decisions(spark, d), _candidates(spark, d), _additions(spark, d), segments(spark, d)))


def q_remaining(spark, d):
    return pr.remaining(_candidates(spark, d), _decisions(spark, d))


def q_resume(spark, d):
    return pr.resume_points(_candidates(spark, d))


def q_evidence(spark, d):
    t = _targets(spark, d).select("stream_id", F.col("lo").alias("obj"), "lo", "hi")
    return pr.evidence_enough(t, segments(spark, d), 150.0)


def q_thin(spark, d):
    return pr.thin(members(spark, d).withColumn("match_ord", F.floor(F.col("match_ord") / 20)), 6)


def _responses(spark, d):
    """Matches of a stream as an annotator's text: plain, fenced, in prose, or cut off."""
    h = mt.heads(members(spark, d))
    item = F.format_string('{"title": "%s", "segment_indices": [%d, "%d", %d], "confidence": %s}', "title", "lo", "hi", "lo", F.when(F.col("match_ord") % 3 == 0, '"high"').otherwise("0.75"))
    text = h.groupBy("stream_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("match_ord", item.alias("i")))), lambda x: x["i"]), ", "), F.lit("]")).alias("j"))
    k = F.col("stream_id") % 4
    raw = F.when(k == 0, F.col("j")).when(k == 1, F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), F.col("j"), F.lit(" done."))).otherwise(F.expr("substring(j, 1, length(j) - 25)"))
    return text.select("stream_id", raw.alias("raw"))


def q_parsed(spark, d):
    return rs.parsed(_responses(spark, d)).select("stream_id", "status")


def q_items(spark, d):
    return rs.items(_responses(spark, d), ["stream_id"])


def q_continued(spark, d):
    i = rs.items(_responses(spark, d), ["stream_id"]).select("stream_id", "pos", "title", "indices")
    rounds = i.withColumn("round", F.lit(1)).union(i.where("pos % 2 = 0").withColumn("round", F.lit(2)))
    return rs.continued(rounds.select("stream_id", "round", "pos", "title", "indices")).select("stream_id", "pos", "title", F.get("indices", 0).alias("first"))


def _logs(spark, d):
    return segments(spark, d).select("stream_id", F.concat_ws("-", "stream_id", "idx").alias("fingerprint"), F.when((F.col("stream_id") + F.col("idx")) % 7 == 0, "timeout").alias("error"), ((F.col("stream_id") + F.col("idx")) % 5 != 0).alias("valid"), (F.col("idx") == 2).alias("repaired"), (F.col("stream_id") % 4 == 0).alias("truncated"), F.col("text").alias("raw"), F.col("idx").alias("round"))


def q_reusable(spark, d):
    return rs.reusable(_logs(spark, d), _logs(spark, d).where("round <> 1").select("fingerprint", "stream_id")).select("stream_id", "fingerprint", "raw")


def q_failures(spark, d):
    return rs.failures(_logs(spark, d))


def q_complete(spark, d):
    return rs.complete(_logs(spark, d))


QUERIES = {
    "v1_discovery": q_discovery, "v2_discovery_reason": q_discovery_reason, "v3_recall_targets": q_targets, "v5_recall_anchors": q_anchors, "v4_recall_reason": q_recall_reason, "v6_adjudication_reason": q_adjudication_reason,
    "v7_apply_decisions": q_apply, "v6_additions_reason": q_additions_reason, "v7_apply_additions": q_apply_additions, "v9_remaining": q_remaining, "v9_resume_points": q_resume, "p11_evidence": q_evidence, "l5_thinning": q_thin, "m7_parse_status": q_parsed, "m8_p1_items": q_items, "m9_continued": q_continued,
    "p8_reusable": q_reusable, "p9_failures": q_failures, "m9_complete": q_complete,
}

_DISC = """rare AS (SELECT * FROM members WHERE title IN ('click', 'purchase')), rr AS (SELECT stream_id, match_ord, idx, idx - row_number() OVER (PARTITION BY stream_id, match_ord ORDER BY idx) AS run FROM rare),
own AS (SELECT stream_id, match_ord * 2 AS obj, min(idx) AS lo, CASE WHEN match_ord % 9 = 0 THEN max(idx) + 1000 ELSE max(idx) END AS hi, ' a' || match_ord AS anchor FROM rr GROUP BY stream_id, match_ord, run),
raw AS (SELECT * FROM own UNION ALL SELECT stream_id, obj + 1, lo, hi, anchor FROM own WHERE obj % 4 = 0), top AS (SELECT stream_id, max(idx) AS t FROM segments GROUP BY ALL),
clamp AS (SELECT stream_id, obj, lo, least(hi, t) AS hi, trim(anchor) AS anchor FROM raw JOIN top USING (stream_id)), ob AS (SELECT stream_id, obj, list([lo, hi] ORDER BY lo, hi) AS ranges, min(anchor) AS anchor FROM clamp GROUP BY ALL),
once AS (SELECT * FROM ob QUALIFY row_number() OVER (PARTITION BY stream_id, ranges ORDER BY obj) = 1),
disc AS (SELECT *, printf('P%03d', row_number() OVER (PARTITION BY stream_id ORDER BY ranges[1], obj)) AS id FROM once)"""
_TARGETS = """rare2 AS (SELECT * FROM members WHERE title IN ('click', 'purchase')), free AS (SELECT stream_id, idx FROM segments ANTI JOIN rare2 USING (stream_id, idx)), fr AS (SELECT *, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS run FROM free), gp AS (SELECT stream_id, min(idx) AS lo, max(idx) AS hi FROM fr GROUP BY stream_id, run),
tt AS (SELECT g.stream_id, lo, hi, greatest(0, l.end_s - f.start_s) AS seconds FROM gp g JOIN segments f ON f.stream_id = g.stream_id AND f.idx = lo JOIN segments l ON l.stream_id = g.stream_id AND l.idx = hi),
targets AS (SELECT stream_id, printf('U%03d', row_number() OVER (PARTITION BY stream_id ORDER BY lo, hi)) AS target, lo, hi FROM tt WHERE seconds >= 10)"""
_ANCHORS = (
    _TARGETS
    + """, ao AS (SELECT *, lo // 2 + stream_id % 2 AS obj FROM targets), anchors AS (SELECT stream_id, obj, CASE WHEN lo % 10 = 9 THEN 'U999' ELSE target END AS target, lo - obj % 2 AS lo, hi + obj % 2 AS hi, 0.7::DOUBLE AS confidence FROM ao),
ac AS (SELECT a.stream_id, obj, a.target, greatest(a.lo, t.lo) AS lo, least(a.hi, t.hi) AS hi, confidence FROM anchors a JOIN targets t USING (stream_id, target) WHERE greatest(a.lo, t.lo) <= least(a.hi, t.hi)), a1 AS (SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY stream_id, target, lo, hi ORDER BY obj) = 1)"""
)
_DEC = (
    _DISC
    + """, cand AS (SELECT stream_id, id, CASE WHEN obj % 3 = 0 THEN '' ELSE anchor END AS anchor, ranges[1][1] AS lo, ranges[1][2] AS hi FROM disc),
d0 AS (SELECT *, substr(id, 2)::BIGINT AS dec, stream_id % 6 AS s FROM cand), decs AS (SELECT stream_id, dec, CASE WHEN s = 1 AND dec = 3 THEN 'guess' WHEN dec % 5 = 0 THEN 'reject' ELSE 'accept' END AS action,
CASE WHEN s = 2 AND dec = 2 THEN 'P998' WHEN s = 3 AND dec = 4 THEN 'P001' ELSE id END AS id, CASE WHEN NOT ((dec % 5 = 0 AND s <> 4) OR (s = 5 AND dec = 1)) THEN lo END AS lo, CASE WHEN NOT ((dec % 5 = 0 AND s <> 4) OR (s = 5 AND dec = 1)) THEN hi END AS hi FROM d0 WHERE NOT (stream_id % 12 = 0 AND dec = 6))"""
)
_ITEMS = """h AS (SELECT stream_id, match_ord, any_value(title) AS title, min(idx) AS lo, max(idx) AS hi FROM members GROUP BY ALL), top AS (SELECT stream_id, max(match_ord) AS last FROM h GROUP BY ALL),
items AS (SELECT stream_id, match_ord AS pos, title, CASE WHEN lo = hi THEN [lo] ELSE [lo, hi] END AS indices, CASE WHEN match_ord % 3 = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence, stream_id % 4 = 3 AS recovered FROM h JOIN top USING (stream_id) WHERE NOT (stream_id % 4 = 3 AND match_ord = last))"""
_LOG = "logs AS (SELECT stream_id, stream_id || '-' || idx AS fingerprint, CASE WHEN (stream_id + idx) % 7 = 0 THEN 'timeout' END AS error, (stream_id + idx) % 5 <> 0 AS valid, idx = 2 AS repaired, stream_id % 4 = 0 AS truncated, text AS raw, idx AS round FROM segments)"

_REASON = _DEC + """, e AS (SELECT d.stream_id, dec, action, c.id IS NULL AS unk, d.lo IS NOT NULL AS ranged FROM decs d LEFT JOIN cand c ON c.stream_id = d.stream_id AND c.id = d.id),
b AS (SELECT stream_id, dec, CASE WHEN action = 'guess' THEN 'invalid_action' WHEN unk THEN 'unknown_id' WHEN action = 'reject' AND ranged THEN 'reject_has_ranges' WHEN action <> 'reject' AND NOT ranged THEN 'missing_ranges' END AS bad FROM e), f AS (SELECT stream_id, (min(row(dec, bad)) FILTER (bad IS NOT NULL))[2] AS bad FROM b GROUP BY ALL),
u AS (SELECT c.stream_id, c.id, count(DISTINCT dec) AS uses FROM cand c LEFT JOIN decs d ON d.stream_id = c.stream_id AND d.id = c.id GROUP BY ALL), cv AS (SELECT stream_id, max(uses) AS most, count(*) FILTER (uses = 0) AS missing FROM u GROUP BY ALL)"""
_REASON_BODY = "SELECT cv.stream_id, coalesce(bad, CASE WHEN most > 1 THEN 'duplicate_id' WHEN missing > 0 THEN 'missing_id' END) AS reason FROM cv LEFT JOIN f ON f.stream_id = cv.stream_id"
_FIN = ", fin AS (SELECT d.stream_id, d.dec AS match_ord, '未知歌曲：' || coalesce(nullif(c.anchor, ''), c.id) AS title, 0.9::DOUBLE AS confidence, d.lo, d.hi FROM decs d JOIN cand c ON c.stream_id = d.stream_id AND c.id = d.id WHERE action <> 'reject' AND d.lo IS NOT NULL)"
_ADDED = """ad AS (SELECT stream_id, lo // 6 AS add, lo, hi, CASE WHEN stream_id % 2 = 0 THEN least(lo + 1, hi) ELSE lo END AS ehi FROM targets), ev AS (SELECT stream_id, add, unnest(range(lo, ehi + 1)) AS idx FROM ad),
eo AS (SELECT ev.stream_id, add, ev.stream_id % 5 <> 0 AND (count(DISTINCT idx) >= 2 OR max(end_s - start_s) >= 10) AS ok FROM ev JOIN segments USING (stream_id, idx) GROUP BY ev.stream_id, add)"""

SQL = {
    "v1_discovery": with_inputs(*_E, more=_DISC, body="SELECT stream_id, obj, id, anchor, 0.8::DOUBLE AS confidence, array_to_string(list_transform(ranges, lambda r: r[1] || '-' || r[2]), ',') AS ranges FROM disc"),
    "v2_discovery_reason": with_inputs(*_E, more=_DISC + ", k AS (SELECT DISTINCT stream_id FROM disc WHERE stream_id % 2 = 0), s AS (SELECT DISTINCT stream_id FROM segments)", body="SELECT s.stream_id, CASE WHEN s.stream_id % 7 = 0 THEN 'discovery_incomplete' WHEN s.stream_id % 3 > 0 AND k.stream_id IS NULL THEN 'discovery_without_ranges' END AS reason FROM s LEFT JOIN k ON k.stream_id = s.stream_id"),
    "v3_recall_targets": with_inputs(*_E, more=_TARGETS, body="SELECT * FROM targets"),
    "v5_recall_anchors": with_inputs(*_E, more=_ANCHORS, body="SELECT *, printf('R%03d', row_number() OVER (PARTITION BY stream_id ORDER BY lo, hi, obj)) AS id FROM a1"),
    "v4_recall_reason": with_inputs(*_E, more=_ANCHORS + ", x AS (SELECT a.stream_id, obj, CASE WHEN t.lo IS NULL THEN 'recall_unknown_target' WHEN a.lo < t.lo OR a.hi > t.hi THEN 'recall_evidence_outside_target' END AS bad FROM anchors a LEFT JOIN targets t USING (stream_id, target))", body="SELECT stream_id, (min(row(obj, bad)) FILTER (bad IS NOT NULL))[2] AS reason FROM x GROUP BY ALL"),
    "v6_adjudication_reason": with_inputs(*_E, more=_REASON, body=_REASON_BODY),
    "v7_apply_decisions": with_inputs(*_E, more=_DEC + _FIN, body="SELECT stream_id, match_ord, title, confidence, lo, hi, hi - lo + 1 AS n FROM fin"),
    "v6_additions_reason": with_inputs(*_E, more=_REASON + ", " + _TARGETS + ", " + _ADDED + f", rs AS ({_REASON_BODY}), ag AS (SELECT stream_id, count(*) AS n, bool_and(ok) AS ok FROM eo GROUP BY ALL), st AS (SELECT DISTINCT stream_id FROM segments)", body="SELECT st.stream_id, CASE WHEN st.stream_id % 13 = 0 THEN 'incomplete' ELSE coalesce(reason, CASE WHEN n > 10 THEN 'too_many_additions' WHEN NOT ok THEN 'addition_without_evidence' END) END AS reason FROM st LEFT JOIN rs USING (stream_id) LEFT JOIN ag USING (stream_id)"),
    "v7_apply_additions": with_inputs(*_E, more=_DEC + _FIN + ", " + _TARGETS + ", " + _ADDED + ", fa AS (SELECT stream_id, add, min(lo) AS lo, max(hi) AS hi, sum(hi - lo + 1)::BIGINT AS n FROM ad GROUP BY ALL), ls AS (SELECT stream_id, max(dec) AS last FROM decs GROUP BY ALL), ao AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY add) AS place FROM fa JOIN eo USING (stream_id, add) WHERE ok)", body="SELECT stream_id, match_ord, title, confidence, lo, hi, hi - lo + 1 AS n FROM fin UNION ALL SELECT ao.stream_id, coalesce(last, 0) + place, '未知歌曲：' || CASE WHEN add % 2 = 0 THEN 't' || add ELSE 'final_discovery' END, 0.7::DOUBLE, lo, hi, n FROM ao LEFT JOIN ls ON ls.stream_id = ao.stream_id"),
    "v9_remaining": with_inputs(*_E, more=_DEC, body="SELECT stream_id, id FROM cand ANTI JOIN decs USING (stream_id, id)"),
    "v9_resume_points": with_inputs(*_E, more=_DEC, body="SELECT stream_id, greatest(0, max(hi) - 4) AS resume FROM cand GROUP BY ALL"),
    "p11_evidence": with_inputs(*_E, more=_TARGETS, body="SELECT stream_id, lo AS obj, lo, hi FROM tt WHERE seconds >= 10 AND (hi > lo OR seconds >= 150)"),
    "l5_thinning": with_inputs(*_E, more="g AS (SELECT stream_id, match_ord // 20 AS match_ord, list_sort(list_distinct(list(idx))) AS ids FROM members GROUP BY stream_id, match_ord // 20), t AS (SELECT *, len(ids) AS n FROM g)", body="SELECT stream_id, match_ord, unnest(CASE WHEN n <= 6 THEN ids ELSE list_distinct(list_concat(list_concat(ids[1:2], ids[greatest(1, (n - 2) // 2 + 1):greatest(1, (n - 2) // 2 + 1) + 1]), ids[n - 1:n])) END) AS idx FROM t"),
    "m7_parse_status": with_inputs(*_E, body="SELECT DISTINCT stream_id, CASE WHEN stream_id % 4 = 3 THEN 'failed' ELSE 'ok' END AS status FROM members"),
    "m8_p1_items": with_inputs(*_E, more=_ITEMS, body="SELECT * FROM items"),
    "m9_continued": with_inputs(*_E, more=_ITEMS + ", f AS (SELECT stream_id, title, indices, min(pos) AS pos FROM items GROUP BY ALL)", body="SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS pos, title, indices[1] AS first FROM f"),
    "p8_reusable": with_inputs(*_E, more=_LOG, body="SELECT stream_id, fingerprint, raw FROM logs WHERE error IS NULL AND valid AND NOT repaired AND NOT truncated AND round <> 1"),
    "p9_failures": with_inputs(*_E, more=_LOG + ", k AS (SELECT stream_id, valid, [CASE WHEN error IS NOT NULL THEN 'error' END, CASE WHEN NOT valid THEN 'invalid_json' END, CASE WHEN repaired THEN 'repaired' END, CASE WHEN truncated THEN 'truncated' END] AS x FROM logs)", body="SELECT stream_id, array_to_string(list_sort(list_distinct(flatten(list(list_filter(x, lambda y: y IS NOT NULL))))), ',') AS failures, bool_and(valid) AS all_valid, bool_or(valid) AS any_valid FROM k GROUP BY ALL"),
    "m9_complete": with_inputs(*_E, more=_LOG, body="SELECT stream_id, arg_max(valid AND NOT truncated, round) AS complete FROM logs GROUP BY ALL"),
}
