"""Queries of the compositions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import intervals as iv, matches as mt, stages as st
from spanloom.plans import interval_queries as iq, match_queries as mq, protocol_queries as pq
from spanloom.plans.inputs import both, members, segments, table, with_inputs

_E = ("segments", "members")
GAP, CAP = mq.GAP, mq.SOFT_MAX


def _searched(spark):
    return spark.createDataFrame([("click",)], "title string")


def q_normalise(spark, d):
    rows, flags = st.normalise(members(spark, d), segments(spark, d), gap_s=GAP, cap_s=30_000.0)
    f = flags.groupBy("stream_id", "match_ord").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return mt.heads(rows).join(f, ["stream_id", "match_ord"], "left")


def q_final(spark, d):
    rows, segs = both(spark, d)
    return mt.heads(st.final_adjudication(rows, segs, _searched(spark), gap_s=GAP, span=12, cap_s=CAP))


def q_residual(spark, d):
    rows, segs = both(spark, d)
    return mt.heads(st.residual_pass(rows, segs, _searched(spark), span=12, cap_s=CAP))


def q_residual_merged(spark, d):
    rows, segs = both(spark, d)
    return mt.heads(st.residual_pass(rows, segs, _searched(spark), span=12, cap_s=CAP, merge_s=GAP))


def q_finish(spark, d):
    m = members(spark, d)
    return mt.heads(st.finish_recheck(m.where("match_ord % 3 <> 0"), m.where("match_ord % 3 = 0"), segments(spark, d), gap_s=GAP, cap_s=CAP)).select("stream_id", "title", "lo", "hi", "n")


def q_candidates(spark, d):
    return st.candidate_matches(pq._candidates(spark, d), "discovery")


def _words(spark, d):
    e = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    w = e.select(F.col("conv_id").alias("stream_id"), F.posexplode(F.split("text", " ")).alias("pos", "word"), "turn")
    idx = F.col("turn") * 100_000 + F.col("pos")
    start = F.col("turn") * 10_000.0 + F.col("pos") * 0.5 + F.floor(F.col("pos") / 9) * 3.0
    return w.select("stream_id", idx.alias("word_idx"), F.when(F.col("pos") % 13 != 5, start).alias("start_s"), (start + 0.25).alias("end_s"), "word")


def q_words(spark, d):
    return st.words_to_segments(_words(spark, d), gap_s=2.0, cap_s=3.0)


def q_budget(spark, d):
    return st.search_budget(members(spark, d), 5)


def q_scan(spark, d):
    return st.scan_windows(iv.uncovered(segments(spark, d), pq._rare(spark, d), 2), 2)


def q_first_gap(spark, d):
    return st.first_gap(segments(spark, d), pq._rare(spark, d), 3)


QUERIES = {
    "c7_normalise": q_normalise, "c14_final_adjudication": q_final, "c15_residual_pass": q_residual, "c15_residual_merged": q_residual_merged, "c19_finish_recheck": q_finish, "v8_candidate_matches": q_candidates,
    "w6_words_to_segments": q_words, "l2_search_budget": q_budget, "w9_scan_windows": q_scan, "l4_first_gap": q_first_gap,
}


def _norm(cap: float, source: str = "members") -> str:
    return f"""n_t AS (SELECT * FROM {source} JOIN segments USING (stream_id, idx)), n_c AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY stream_id, match_ord ORDER BY idx) > {GAP} THEN 1 ELSE 0 END AS cut FROM n_t),
n_p AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id, match_ord ORDER BY idx)::BIGINT AS part FROM n_c), n_k AS (SELECT stream_id, match_ord, part, min(idx) AS lo, count(*) OVER (PARTITION BY stream_id, match_ord) > 1 AS split FROM n_p GROUP BY stream_id, match_ord, part),
n_n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY lo, match_ord, part) - 1 AS new FROM n_k), n_r AS (SELECT p.stream_id, new AS match_ord, title, confidence, idx, split, start_s, end_s FROM n_p p JOIN n_n USING (stream_id, match_ord, part)),
n_s AS (SELECT stream_id, match_ord, lower(trim(any_value(title))) AS key, list_sort(list_distinct(list(idx))) AS ids FROM n_r GROUP BY ALL), n_f AS (SELECT stream_id, min(match_ord) AS match_ord FROM n_s GROUP BY stream_id, key, ids),
norm AS (SELECT n_r.* FROM n_r SEMI JOIN n_f USING (stream_id, match_ord)), flag AS (SELECT stream_id, match_ord, any_value(split) AS split, arg_max(end_s, idx) - arg_min(start_s, idx) > {cap} AS long FROM norm GROUP BY ALL)"""


_HEADS = mq._HEADS


def _adjudicated(source: str, suspicious: str) -> str:
    """The cluster and selection SQL over another table of members, with other suspicious matches."""
    text = mq._SELECT.replace("FROM members", f"FROM {source}").replace("JOIN members", f"JOIN {source}")
    text = text.replace("x.confidence < 0.3 AND y.confidence < 0.3", suspicious.format("x") + " AND " + suspicious.format("y")).replace("FROM h WHERE confidence < 0.3", f"FROM h WHERE {suspicious.format('h')}")
    return text + f", won AS (SELECT * FROM {source} ANTI JOIN (SELECT * FROM greedy WHERE NOT keep) USING (stream_id, match_ord))"


_MERGE = mq._merge_sql(False).replace("FROM members", "FROM norm").replace("JOIN members", "JOIN norm")
_BASE = """shift AS (SELECT stream_id, max(match_ord) + 1 AS s FROM members WHERE match_ord % 3 <> 0 GROUP BY ALL), lists AS (SELECT stream_id, match_ord, title, confidence, idx FROM members WHERE match_ord % 3 <> 0
UNION ALL SELECT m.stream_id, match_ord + coalesce(s, 0), title, confidence, idx FROM members m LEFT JOIN shift USING (stream_id) WHERE match_ord % 3 = 0)"""
_WORDS = """w0 AS (SELECT conv_id AS stream_id, turn, string_split(min(text), ' ') AS w FROM conversations GROUP BY conv_id, turn), w1 AS (SELECT stream_id, turn, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM w0),
w2 AS (SELECT stream_id, turn * 100000 + pos AS word_idx, turn * 10000.0::DOUBLE + pos * 0.5::DOUBLE + pos // 9 * 3.0::DOUBLE AS start_s, word FROM w1 WHERE pos % 13 <> 5 AND trim(word) <> ''),
w3 AS (SELECT *, start_s + 0.25 AS end_s, row_number() OVER (PARTITION BY stream_id ORDER BY word_idx) AS k FROM w2),
fold AS (SELECT stream_id, k, start_s, end_s, word AS text, 1::BIGINT AS o FROM w3 WHERE k = 1 UNION ALL SELECT x.stream_id, x.k, CASE WHEN j THEN f.start_s ELSE x.start_s END, x.end_s, CASE WHEN j THEN f.text || x.word ELSE x.word END, CASE WHEN j THEN f.o ELSE f.o + 1 END
FROM fold f JOIN w3 x ON x.stream_id = f.stream_id AND x.k = f.k + 1, LATERAL (SELECT x.start_s - f.end_s <= 2.0 AND x.end_s - f.start_s <= 3.0 AS j))"""

SQL = {
    "c7_normalise": with_inputs(*_E, more=_norm(30_000.0) + f", hd AS ({_HEADS.format('norm')})", body="SELECT hd.*, CASE WHEN split OR long THEN array_to_string(list_filter([CASE WHEN long THEN 'over_long' END, CASE WHEN split THEN 'split' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM hd JOIN flag USING (stream_id, match_ord)"),
    "c14_final_adjudication": with_inputs(*_E, more=_norm(CAP) + ", " + _adjudicated("norm", "false"), body=_HEADS.format("won")),
    "c15_residual_pass": with_inputs(*_E, more=_adjudicated("members", "false"), body=_HEADS.format("won")),
    "c15_residual_merged": with_inputs(*_E, more=_adjudicated("members", "false") + ", " + mq._merge_sql(False).replace("FROM members", "FROM won").replace("JOIN members", "JOIN won"), body=_HEADS.format("merged")),
    "c19_finish_recheck": with_inputs(*_E, more=_BASE + ", " + _norm(CAP, "lists") + ", " + _MERGE, body=f"SELECT stream_id, title, lo, hi, n FROM ({_HEADS.format('merged')})"),
    "v8_candidate_matches": with_inputs(*_E, more=pq._DEC, body="SELECT stream_id, id, '未知歌曲：' || coalesce(nullif(trim(anchor), ''), id) AS title, 'discovery,' || id AS tags, lo, hi FROM cand"),
    "w6_words_to_segments": f"WITH RECURSIVE {_WORDS}, seg AS (SELECT stream_id, o, arg_max(start_s, k) AS start_s, arg_max(end_s, k) AS end_s, arg_max(text, k) AS text FROM fold GROUP BY ALL) SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_s, end_s) - 1 AS idx, start_s, end_s, text FROM seg",
    "l2_search_budget": with_inputs(*_E, more=f"hd AS ({_HEADS.format('members')})", body="SELECT stream_id, match_ord, row_number() OVER (PARTITION BY stream_id ORDER BY lo, match_ord) AS k FROM hd WHERE confidence < 0.5 QUALIFY k <= 5"),
    "w9_scan_windows": with_inputs(*_E, more=iq._FREE + ", ch AS (SELECT stream_id, c AS lo, least(hi, c + 1) AS hi FROM (SELECT *, unnest(range(lo, hi + 1, 2)) AS c FROM long))", body="SELECT *, printf('W%03d', row_number() OVER (PARTITION BY stream_id ORDER BY lo, hi)) AS id FROM ch"),
    "l4_first_gap": with_inputs(*_E, more=iq._FREE, body="SELECT stream_id, min(row(lo, hi))[1] AS lo, min(row(lo, hi))[2] AS hi FROM gaps WHERE n >= 3 GROUP BY stream_id"),
}
