"""Queries of whole runs: the three rounds, with every kind of answer among the streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.scalars import HAN_HEAD, HAN_TAIL, PAGE_TAILS, SITE_TAILS, page_title
from spanloom.operators import matches as mt, naming as nm, protocol as pr, rounds as rd, stages as st
from spanloom.plans import match_queries as mq, protocol_queries as pq, stage_queries as sq
from spanloom.plans.inputs import both, members, segments, table, with_inputs
from spanloom.sources.checkpoints import dealt

_E = ("segments", "members")
RULES = rd.Rules(gap_s=mq.GAP, cap_s=mq.SOFT_MAX, span=12, risk={"soft_min": mq.SOFT_MIN, "soft_max": mq.SOFT_MAX, "gap": mq.RISK_GAP})


def _answers(rows, segs):
    """Answers of which some are incomplete or break a rule, by the stream's number."""
    ranges = dealt(pq.raw_ranges(rows))
    streams, s = segs.select("stream_id").distinct(), F.col("stream_id")
    said = streams.select(s, (s % 7 != 0).alias("complete"), (s % 3).alias("raw_objects"))
    covered = pr.discovery(ranges, segs).select("stream_id", F.explode("ranges").alias("r")).select("stream_id", F.explode(F.sequence("r.lo", "r.hi")).alias("idx"))
    targets = dealt(pr.recall_targets(segs, covered).withColumn("obj", F.substring("target", 2, 9).cast("long")))
    o = F.col("obj")
    anchors = targets.select(
        "stream_id", "obj", F.when((s % 10 == 3) & (o == 2), "U999").otherwise(F.col("target")).alias("target"), "lo", (F.least("hi", F.col("lo") + 2) + F.when((s % 10 == 5) & (o == 1), 1000).otherwise(0)).alias("hi"), F.lit(0.7).alias("confidence"),
        F.when(o % 3 != 0, F.concat(F.lit(" r"), "obj")).alias("anchor"),
    )
    recall = streams.select(s, (s % 11 != 0).alias("complete"))
    extra = targets.where("obj % 4 = 0 and stream_id % 5 <> 0").select("stream_id", F.col("obj").alias("add"), "lo", "hi", F.lit(True).alias("final_discovery"), F.lit(0.75).alias("confidence"), F.lit(None).cast("string").alias("anchor"))
    additions = extra.withColumn("hi", F.least("hi", F.col("lo") + 3)).withColumn("kind", F.lit("final")).unionByName(extra.withColumn("hi", F.least("hi", F.col("lo") + 1)).withColumn("kind", F.lit("evidence")))
    adjudication = streams.select(s, (s % 13 != 0).alias("complete"))
    some = rd.Answers(ranges, said, anchors, recall, None, additions, adjudication)
    every, _, _ = rd.candidates(some, segs, RULES)  # kept there
    dec = F.substring("id", 2, 9).cast("long") + F.when(F.startswith(F.col("id"), F.lit("R")), 1000).otherwise(0)
    rows = every.withColumn("dec", dec).where("not (stream_id % 12 = 0 and dec = 1)")
    action = F.when((s % 6 == 1) & (F.col("dec") == 3), "guess").when(F.col("dec") % 5 == 0, "reject").otherwise("accept")
    drawn = lambda c: F.when(F.col("dec") % 5 != 0, F.col(c)).alias(c)
    return some._replace(anchors=dealt(anchors), additions=dealt(additions), decisions=rows.select("stream_id", "dec", action.alias("action"), "id", drawn("lo"), drawn("hi"), F.lit(0.9).alias("confidence")))


def _run(spark, d, **more):
    rows, segs = both(spark, d)
    return rd.three_round_run(segs, _answers(rows, segs), RULES, searched=sq._searched(spark), **more)


def q_rounds(spark, d):
    return dealt(_run(spark, d).audit)


def q_matches(spark, d):
    return _run(spark, d).matches.drop("snippet")


def _repair(spark, d, **more):
    rows, segs = both(spark, d)
    return st.boundary_risk(rows.where("title <> 'view' or match_ord % 2 = 0"), segs, gap_s=mq.GAP, cap_s=mq.SOFT_MAX / 2, risk=RULES.risk, **more)


def q_boundary_risk(spark, d):
    return dealt(_repair(spark, d).records.select("stream_id", "match_ord", "title", "score", "action"))


def q_boundary_events(spark, d):
    return dealt(_repair(spark, d).events)


def q_chorus(spark, d):
    """Matches of a stream's day, kept whole over a gap beside which the events are of one kind."""
    rows = members(spark, d).groupBy("stream_id", F.floor(F.col("idx") / 20).alias("match_ord"), "idx").agg(F.lit("day").alias("title"), F.lit(0.5).alias("confidence"))
    return mt.heads(st.normalise(rows, segments(spark, d), gap_s=43200.0, cap_s=0.0, chorus=st.Chorus(mq.GAP, 0.3, 1))[0])


#: What web sites make of a title, one for each rule.
WEB_FORMS = (
    "{} (Official Video)", "{} - lyrics", "{} MV HD", "{} With Pinyin By Me", "你好{} 歌詞 x", "你好{} The Good Day", "Ni Hao 你好{}", "{} The Good Day", "{} | TikTok", "{} - Shazam", "{} - Spotify", "{} - YouTube", "{} - KKBOX", "{} | Genius", "{} - AZLyrics.com",
    "{} - JustSomeLyrics", "{} - hymnal.net", "{} Song Lyrics, Music Videos & Concerts", "{} Music Videos & Concerts", "{} arranged by Me", "{} (book)", "  {}   ok ", "{} (LIVE) | YouTube",
)


def q_page_titles(spark, d):
    parts = table(spark, d, "part")
    form = F.element_at(F.array(*map(F.lit, WEB_FORMS)), (F.col("p_partkey") % len(WEB_FORMS) + 1).cast("int"))
    raw = F.replace(form, F.lit("{}"), F.col("p_name"))
    return parts.select("p_partkey", page_title(raw).alias("title"))


def _looked_up(spark, d):
    """Matches named after benchmark texts, every third known already; what a search finds for each, and hints for some."""
    b = table(spark, d, "benchmark").withColumn("i", F.col("item_id"))
    title = F.when(F.col("i") % 3 == 0, F.concat(F.lit("Known "), "i")).otherwise(F.concat(F.lit("未知歌曲："), "i"))
    matches = b.select(F.floor(F.col("i") / 10).alias("stream_id"), F.col("i").alias("match_ord"), title.alias("title"), F.lit("").alias("artist"), F.lit("x").alias("tags"), F.col("text").alias("snippet"), F.lit("").alias("description"))
    some = b.select(F.left("text", F.lit(100)).alias("query"), "i", "text", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"))
    name = F.when((F.col("i") + F.col("rank")) % 5 == 0, " ").otherwise(F.concat(F.lit("T"), "i", F.lit("."), "rank", F.lit(" - YouTube")))
    said = F.when((F.col("i") + F.col("rank")) % 4 == 0, F.col("text")).otherwise(F.lit("zzz qqq"))
    hints = F.when(F.col("i") % 8 == 1, F.array(F.lit(" "), F.col("text")))
    return matches, some.select("query", "rank", name.alias("title"), F.when(F.col("i") % 2 == 0, "Someone").alias("artist"), said.alias("snippet"), hints.alias("hints"))


def _searched(spark, d):
    matches, results = _looked_up(spark, d)
    nothing = members(spark, d).where("false")
    return nm.search_verification(matches, nothing, segments(spark, d), results, most=4)


def q_search_matches(spark, d):
    return _searched(spark, d)[0].select("stream_id", "match_ord", "title", "artist", "tags")


def q_search_audit(spark, d):
    return _searched(spark, d)[1].drop("query")


QUERIES = {
    "v10_three_rounds": q_rounds, "v10_matches": q_matches, "c11_boundary_risk": q_boundary_risk, "c11_events": q_boundary_events, "c7_chorus": q_chorus, "f22_page_titles": q_page_titles, "c25_search_matches": q_search_matches, "c25_search_audit": q_search_audit,
}

_V = pq._DISC + """, st AS (SELECT DISTINCT stream_id FROM segments), v_de AS (SELECT st.stream_id, CASE WHEN st.stream_id % 7 = 0 THEN 'discovery_incomplete' WHEN st.stream_id % 3 > 0 AND k.stream_id IS NULL THEN 'discovery_without_ranges' END AS e FROM st LEFT JOIN (SELECT DISTINCT stream_id FROM disc) k ON k.stream_id = st.stream_id),
v_go AS (SELECT stream_id FROM v_de WHERE e IS NULL), v_first AS (SELECT stream_id, id, 'precision_discovery' AS source, anchor, 0.8::DOUBLE AS confidence, unnest(ranges) AS r FROM disc SEMI JOIN v_go USING (stream_id)),
v_cov AS (SELECT DISTINCT stream_id, unnest(range(r[1], r[2] + 1)) AS idx FROM v_first), v_free AS (SELECT stream_id, idx FROM segments SEMI JOIN v_go USING (stream_id) ANTI JOIN v_cov USING (stream_id, idx)),
v_fr AS (SELECT *, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS run FROM v_free), v_gp AS (SELECT stream_id, min(idx) AS lo, max(idx) AS hi FROM v_fr GROUP BY stream_id, run),
v_tt AS (SELECT g.stream_id, lo, hi FROM v_gp g JOIN segments f ON f.stream_id = g.stream_id AND f.idx = lo JOIN segments l ON l.stream_id = g.stream_id AND l.idx = hi WHERE greatest(0, l.end_s - f.start_s) >= 10),
v_t AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY lo, hi) AS obj FROM v_tt),
v_an AS (SELECT stream_id, obj, stream_id % 10 = 3 AND obj = 2 AS unknown, lo, hi AS thi, least(hi, lo + 2) + CASE WHEN stream_id % 10 = 5 AND obj = 1 THEN 1000 ELSE 0 END AS hi, CASE WHEN obj % 3 <> 0 THEN 'r' || obj ELSE '' END AS anchor FROM v_t),
v_ra AS (SELECT stream_id, (min(row(obj, bad)) FILTER (bad IS NOT NULL))[2] AS bad FROM (SELECT *, CASE WHEN unknown THEN 'recall_unknown_target' WHEN hi > thi THEN 'recall_evidence_outside_target' END AS bad FROM v_an) GROUP BY ALL),
v_re AS (SELECT st.stream_id, CASE WHEN st.stream_id % 11 = 0 THEN 'recall_incomplete' ELSE bad END AS e FROM st LEFT JOIN v_ra ON v_ra.stream_id = st.stream_id),
v_second AS (SELECT a.stream_id, printf('R%03d', row_number() OVER (PARTITION BY a.stream_id ORDER BY lo, hi, obj)) AS id, 'recall_audit' AS source, anchor, 0.7::DOUBLE AS confidence, [lo, hi] AS r FROM v_an a JOIN v_re ON v_re.stream_id = a.stream_id AND e IS NULL),
v_every AS (SELECT * FROM v_first UNION ALL SELECT * FROM v_second),
v_d0 AS (SELECT *, substr(id, 2)::BIGINT + CASE WHEN id LIKE 'R%' THEN 1000 ELSE 0 END AS dec FROM v_every), v_dec AS (SELECT *, CASE WHEN stream_id % 6 = 1 AND dec = 3 THEN 'guess' WHEN dec % 5 = 0 THEN 'reject' ELSE 'accept' END AS action FROM v_d0 WHERE NOT (stream_id % 12 = 0 AND dec = 1)),
v_ids AS (SELECT DISTINCT stream_id, id FROM v_every), v_miss AS (SELECT stream_id, bool_or(dec IS NULL) AS missing FROM v_ids LEFT JOIN (SELECT DISTINCT stream_id, id, dec FROM v_dec) USING (stream_id, id) GROUP BY ALL), v_guess AS (SELECT DISTINCT stream_id FROM v_dec WHERE action = 'guess'),
v_ad AS (SELECT stream_id, obj AS add, lo, least(hi, lo + 3) AS hi, least(hi, lo + 1) AS ehi FROM v_t WHERE obj % 4 = 0 AND stream_id % 5 <> 0), v_ok AS (SELECT a.stream_id, add, a.lo, a.hi, ehi > a.lo OR s.end_s - s.start_s >= 10 AS ok FROM v_ad a JOIN segments s ON s.stream_id = a.stream_id AND s.idx = a.lo),
v_adr AS (SELECT stream_id, count(*) AS n, bool_and(ok) AS ok FROM v_ok GROUP BY ALL),
v_ae AS (SELECT g.stream_id, CASE WHEN g.stream_id % 13 = 0 THEN 'incomplete' WHEN gu.stream_id IS NOT NULL THEN 'invalid_action' WHEN missing THEN 'missing_id' WHEN n > 10 THEN 'too_many_additions' WHEN NOT a.ok THEN 'addition_without_evidence' END AS e
  FROM v_go g LEFT JOIN v_guess gu ON gu.stream_id = g.stream_id LEFT JOIN v_miss m ON m.stream_id = g.stream_id LEFT JOIN v_adr a ON a.stream_id = g.stream_id),
v_done AS (SELECT stream_id FROM v_ae WHERE e IS NULL), v_last AS (SELECT stream_id, max(dec) AS last FROM v_dec GROUP BY ALL),
v_mem AS (SELECT DISTINCT stream_id, dec AS match_ord, '未知歌曲：' || coalesce(nullif(anchor, ''), id) AS title, 0.9::DOUBLE AS confidence, 'v3_adjudicated,' || action || ',' || id AS tags, unnest(range(r[1], r[2] + 1)) AS idx FROM v_dec SEMI JOIN v_done USING (stream_id) WHERE action <> 'reject'
  UNION ALL SELECT stream_id, coalesce(last, 0) + place, '未知歌曲：final_discovery', 0.75::DOUBLE, 'v3_adjudicated,final_discovery', unnest(range(lo, hi + 1)) FROM (SELECT o.*, row_number() OVER (PARTITION BY stream_id ORDER BY add) AS place FROM v_ok o SEMI JOIN v_done USING (stream_id)) LEFT JOIN v_last USING (stream_id)
  UNION ALL SELECT DISTINCT stream_id, k, '未知歌曲：' || coalesce(nullif(anchor, ''), id), confidence, CASE source WHEN 'recall_audit' THEN 'unadjudicated_recall_anchor' ELSE source END || ',' || id, unnest(range(r[1], r[2] + 1)) FROM (SELECT *, dense_rank() OVER (PARTITION BY stream_id ORDER BY source, id) AS k FROM v_every SEMI JOIN (SELECT stream_id FROM v_ae WHERE e IS NOT NULL) USING (stream_id))),
""" + sq._norm(mq.SOFT_MAX, "v_mem").replace("title, confidence, idx, split", "title, confidence, tags, idx, split") + ", " + sq._adjudicated("norm", "false") + f", v_hd AS ({mq._HEADS.format('won')}), v_tags AS (SELECT stream_id, match_ord, any_value(tags) AS tags FROM won GROUP BY ALL)"
_COUNT = "(SELECT stream_id, count(DISTINCT {}) AS n FROM {} GROUP BY ALL)"
_REVIEW = ", v_nm AS (SELECT stream_id, match_ord, title, confidence, idx FROM norm), " + mq._RISKS.replace("FROM members", "FROM v_nm").replace("JOIN members", "JOIN v_nm") + ", v_rv AS (SELECT stream_id, match_ord FROM scored WHERE short OR long OR far IS NOT NULL OR boundary >= 0.75 OR score >= 0.55 OR overlap > 0)"

_BR = "fewer AS (SELECT * FROM members WHERE title <> 'view' OR match_ord % 2 = 0), " + sq._norm(mq.SOFT_MAX / 2, "fewer") + ", v_nm AS (SELECT stream_id, match_ord, title, confidence, idx FROM norm)"
_EVENTS = _BR + """, b_r AS (SELECT stream_id, match_ord, any_value(title) AS title, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS before FROM (SELECT stream_id, match_ord, any_value(title) AS title, min(idx) AS lo, max(idx) AS hi FROM (SELECT *, idx - row_number() OVER (PARTITION BY stream_id, match_ord ORDER BY idx) AS run FROM fewer) GROUP BY stream_id, match_ord, run) GROUP BY ALL),
b_q AS (SELECT stream_id, match_ord, part, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS ranges FROM (SELECT stream_id, match_ord, part, min(idx) AS lo, max(idx) AS hi FROM (SELECT *, idx - row_number() OVER (PARTITION BY stream_id, match_ord, part ORDER BY idx) AS run FROM n_p) GROUP BY stream_id, match_ord, part, run) GROUP BY ALL),
b_s AS (SELECT stream_id, match_ord, string_agg(ranges, ';' ORDER BY part) AS ranges FROM b_q GROUP BY ALL HAVING count(*) > 1), b_n AS (SELECT q.stream_id, new, ranges FROM b_q q JOIN n_n USING (stream_id, match_ord, part)),
b_d AS (SELECT n.stream_id, n.match_ord, any_value(title) AS title, arg_max(end_s, idx) - arg_min(start_s, idx) AS d FROM norm n GROUP BY ALL)"""
_TOK = "CASE WHEN len(regexp_extract_all({0}, '[一-鿿]')) > length({0}) * 0.3 THEN [] ELSE list_filter(regexp_split_to_array(lower(trim({0})), '\\s+'), lambda w: regexp_matches(w, '^\\pL+$')) END"
_LOOK = f"""lm AS (SELECT item_id // 10 AS stream_id, item_id AS match_ord, text, CASE WHEN item_id % 3 = 0 THEN 'Known ' || item_id ELSE '未知歌曲：' || item_id END AS title FROM benchmark),
lk AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY match_ord) AS k FROM lm WHERE title LIKE '未知歌曲%' QUALIFY k <= 4),
li AS (SELECT match_ord, r, CASE WHEN match_ord % 2 = 0 THEN 'Someone' END AS artist, 'T' || match_ord || '.' || r AS t, CASE WHEN (match_ord + r) % 4 = 0 THEN text ELSE 'zzz qqq' END AS s, row_number() OVER (PARTITION BY match_ord ORDER BY r) = 1 AS first, text, match_ord % 8 = 1 AS hinted FROM (SELECT *, unnest([1, 2, 3]) AS r FROM lk) WHERE (match_ord + r) % 5 <> 0),
lt AS (SELECT match_ord, r, t, artist, list_distinct({_TOK.format('text')}) AS a, list_distinct(list_concat({_TOK.format('s')}, CASE WHEN first AND hinted THEN {_TOK.format('text')} ELSE [] END)) AS b FROM li),
lb AS (SELECT match_ord, count(*) AS c, min(row(r, t, artist, v)) FILTER (v >= 0.15) AS best FROM (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END AS v FROM lt) GROUP BY ALL)"""


def _web_sql(text: str) -> str:
    """The title rules, one replacement after the other."""
    cut = lambda x, tails: cut(f"regexp_replace({x}, '(?i){tails[0]}', '')", tails[1:]) if tails else x
    return f"""w1 AS (SELECT p_partkey, {cut(text, PAGE_TAILS)} AS t FROM part), w2 AS (SELECT p_partkey, CASE WHEN regexp_matches(t, '[一-鿿]') THEN trim(regexp_replace(regexp_replace(t, '(?i){HAN_TAIL}', ''), '{HAN_HEAD}', '\\1')) ELSE t END AS t FROM w1),
w3 AS (SELECT p_partkey, trim(regexp_replace({cut('t', SITE_TAILS)}, '\\s+', ' ', 'g')) AS title FROM w2)"""


_FORMS = "[" + ", ".join(f"'{f}'" for f in WEB_FORMS) + "]"

SQL = {
    "c11_boundary_risk": with_inputs(*_E, more=_BR + ", " + mq._RISKS.replace("FROM members", "FROM v_nm").replace("JOIN members", "JOIN v_nm"), body="SELECT stream_id, match_ord, title, score, CASE WHEN score >= 0.9 THEN 'review_requires_evidence' WHEN short OR long OR far IS NOT NULL OR boundary >= 0.75 OR score >= 0.55 OR overlap > 0 THEN 'review' ELSE 'accept' END AS action FROM scored"),
    "c11_events": with_inputs(*_E, more=_EVENTS, body=f"""SELECT stream_id, 'risk_boundary_split' AS type, match_ord AS source_ord, title, before, ranges, NULL::DOUBLE AS seconds FROM b_s JOIN b_r USING (stream_id, match_ord)
UNION ALL SELECT s.stream_id, 'exact_duplicate', s.match_ord, t.title, '', ranges, NULL FROM n_s s ANTI JOIN n_f f ON f.stream_id = s.stream_id AND f.match_ord = s.match_ord JOIN b_n b ON b.stream_id = s.stream_id AND b.new = s.match_ord JOIN (SELECT DISTINCT stream_id, match_ord, title FROM n_r) t ON t.stream_id = s.stream_id AND t.match_ord = s.match_ord
UNION ALL SELECT d.stream_id, 'overlong', d.match_ord, title, '', ranges, d FROM b_d d JOIN b_n b ON b.stream_id = d.stream_id AND b.new = d.match_ord WHERE d > {mq.SOFT_MAX / 2}"""),
    "c7_chorus": with_inputs(*_E, more=f"day AS (SELECT DISTINCT stream_id, idx // 20 AS match_ord, idx FROM members), t AS (SELECT * FROM day JOIN segments USING (stream_id, idx)), c AS (SELECT *, start_s - lag(end_s) OVER w AS gap, lag(text) OVER w AS b FROM t WINDOW w AS (PARTITION BY stream_id, match_ord ORDER BY idx)), k AS (SELECT *, CASE WHEN gap > {mq.GAP} OR (gap > 43200.0 AND NOT coalesce(lower(b) = lower(text) AND regexp_matches(text, '^\\pL+$'), false)) THEN 1 ELSE 0 END AS cut FROM c), p AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, match_ord ORDER BY idx)::BIGINT AS part FROM k), g AS (SELECT stream_id, match_ord, part, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM p GROUP BY ALL)", body="SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY lo, match_ord, part) - 1 AS match_ord, 'day' AS title, 0.5::DOUBLE AS confidence, lo, hi, n FROM g"),
    "f22_page_titles": f"WITH {_web_sql(f'replace({_FORMS}[p_partkey % {len(WEB_FORMS)} + 1], {chr(39)}{{}}{chr(39)}, p_name)')} SELECT * FROM w3",
    "c25_search_matches": f"WITH {_LOOK} SELECT stream_id, lm.match_ord, coalesce(best[2], title) AS title, coalesce(best[3], '') AS artist, CASE WHEN best IS NULL THEN 'x' ELSE 'x,search_verified' END AS tags FROM lm LEFT JOIN lb ON lb.match_ord = lm.match_ord",
    "c25_search_audit": f"WITH {_LOOK} SELECT stream_id, lk.match_ord, title AS old_title, coalesce(c, 0) AS candidates, best[2] AS best_title, best[3] AS best_artist, coalesce(best[4], 0)::DOUBLE AS score, best IS NOT NULL AS accepted, CASE WHEN best IS NOT NULL THEN 'lyrics_evidence_found' WHEN c IS NULL THEN 'no_items' ELSE 'insufficient_evidence' END AS reason FROM lk LEFT JOIN lb ON lb.match_ord = lk.match_ord",
    "v10_three_rounds": with_inputs(*_E, more=_V + _REVIEW, body=f"""SELECT d.stream_id, CASE WHEN d.e IS NOT NULL THEN 'discovery_structural_failure' WHEN r.e IS NOT NULL THEN 'recall_incomplete' WHEN a.e IS NOT NULL THEN 'adjudication_incomplete' ELSE 'complete' END AS status, d.e AS discovery_error, CASE WHEN d.e IS NULL THEN r.e END AS recall_error, a.e AS adjudication_error,
coalesce(c1.n, 0) AS discovered, coalesce(c2.n, 0) AS targets, coalesce(c3.n, 0) AS recalled, coalesce(c4.n, 0) AS adjudicated, coalesce(c5.n, 0) AS review, coalesce(c6.n, 0) AS final FROM v_de d JOIN v_re r ON r.stream_id = d.stream_id LEFT JOIN v_ae a ON a.stream_id = d.stream_id
LEFT JOIN {_COUNT.format('id', 'v_first')} c1 ON c1.stream_id = d.stream_id LEFT JOIN {_COUNT.format('obj', 'v_t')} c2 ON c2.stream_id = d.stream_id LEFT JOIN {_COUNT.format('id', 'v_second')} c3 ON c3.stream_id = d.stream_id
LEFT JOIN {_COUNT.format('match_ord', 'v_mem')} c4 ON c4.stream_id = d.stream_id LEFT JOIN {_COUNT.format('match_ord', 'v_rv')} c5 ON c5.stream_id = d.stream_id LEFT JOIN {_COUNT.format('match_ord', 'v_hd')} c6 ON c6.stream_id = d.stream_id"""),
    "v10_matches": with_inputs(*_E, more=_V, body="SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY lo, match_ord) - 1 AS match_ord, title, '' AS artist, tags, confidence, lo, hi, n FROM v_hd JOIN v_tags USING (stream_id, match_ord)"),
}
