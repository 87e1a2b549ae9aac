"""The older run keeps its tables dealt by stream, and its steps read what they share once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanloom.operators import annotate as an, legacy as lg, matches as mt, stages as st
from spanloom.sources.checkpoints import _AS_DEALT, dealt, few


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _streams(spark):
    rng = random.Random(5)
    segments = [(s, i, i * 30.0 + rng.random(), i * 30.0 + rng.choice([5.0, 25.0]), "t") for s in range(6) for i in range(30)]
    members = [(s, m, rng.choice("abc"), rng.randrange(100) / 100, i) for s in range(6) for m in range(8) for i in sorted(rng.sample(range(30), 4))]
    members = [(s, m, "abc"[(s + m) % 3], 0.1 * m, i) for s, m, _, _, i in members]
    return spark.createDataFrame(members, "stream_id long, match_ord long, title string, confidence double, idx long"), spark.createDataFrame(segments, "stream_id long, idx long, start_s double, end_s double, text string")


def test_parts_are_numbered_without_a_join(spark):
    members, segments = _streams(spark)
    parts = st.split(members, segments, 20.0).localCheckpoint()
    got = st._renumbered(parts)
    assert "Join" not in plan_of(got)
    first, several = {}, {}
    for r in parts.collect():
        k = (r.stream_id, r.match_ord, r.part)
        first[k] = min(first.get(k, r.idx), r.idx)
        several.setdefault(k[:2], set()).add(r.part)
    new = {k: n for s in range(6) for n, k in enumerate(sorted((k for k in first if k[0] == s), key=lambda k: (first[k], *k[1:])))}
    rows = got.collect()
    assert len(rows) == parts.count() and len(new) > len(several)
    assert all(r.match_ord == new[r.stream_id, r.source_ord, r.part] and r.several == (len(several[r.stream_id, r.source_ord]) > 1) for r in rows)


def test_normalised_rows_may_be_kept_once(spark):
    members, segments = _streams(spark)
    plain, kept = [], []
    for out, how in ((plain, {}), (kept, {"keep": dealt})):
        n = st.normalised(members, segments, gap_s=20.0, cap_s=100.0, **how)
        out += [sorted(map(tuple, df.collect()), key=repr) for df in n]
    assert plain == kept and all(plain)


def test_the_run_stays_dealt_by_stream(spark):
    members, segments = _streams(spark)
    run = lg.legacy_run(dealt(members), dealt(segments), lambda r: r.select(*an.REQUEST, F.lit("[]").alias("raw")), lg.Rules(gap_s=20.0, cap_s=100.0, context=1, chunk=6, pack=12, least_s=10.0))
    before = {name: spark.conf.get(name) for name in _AS_DEALT}
    try:
        for name, value in _AS_DEALT.items():
            spark.conf.set(name, value)
        met = run.members.hint("merge").join(dealt(segments), ["stream_id", "idx"]).groupBy("stream_id", "match_ord").count()
        assert "Exchange" not in plan_of(met)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert run.members.count() > 0


def test_few_common_keys_bring_no_crowd_together(spark):
    rows, keys = spark.range(1000).select((F.col("id") % 2).alias("k"), "id"), spark.range(50).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(rows.join(few(keys), "k", "left"))
        assert "BroadcastHashJoin" not in plan_of(rows.join(few(keys, 49), "k", "left"))
        members, segments = _streams(spark)
        rows = mt.drop_duplicates(members).localCheckpoint()
        cluster = mt.heads(rows).select("stream_id", "match_ord", F.lit(0).cast("long").alias("cluster"))
        assert "BroadcastHashJoin" in plan_of(mt.select_best(rows, cluster, segments, spark.createDataFrame([("a",)], "title string"), 100.0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
