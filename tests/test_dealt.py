"""Tables that are kept dealt by a key, and steps that multiplied or moved rows before."""

from pyspark.sql import functions as F

from spanloom.operators import coverage as cv, media
from spanloom.sources.checkpoints import _AS_DEALT, dealt


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_kept_dealt_moves_no_more(spark):
    """Neither in groups nor in joins by more than the key, and the session's settings are as before."""
    before = {c: spark.conf.get(c) for c in _AS_DEALT}
    rows = dealt(spark.range(50).select((F.col("id") % 5).alias("stream_id"), F.col("id").alias("idx")))
    assert {c: spark.conf.get(c) for c in _AS_DEALT} == before
    assert "Exchange" not in plan_of(rows.groupBy("stream_id", "idx").count())
    try:
        for name, value in _AS_DEALT.items():
            spark.conf.set(name, value)
        met = rows.hint("merge").join(dealt(rows.where("idx % 2 = 0")), ["stream_id", "idx"])
        assert "Exchange" not in plan_of(met)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert met.count() == 25


def test_alike_parts_are_told_without_multiplying_rows(spark):
    parts = [(1, 0, 1.0, "a", 2, 2, 30.0, True), (1, 1, 1.0, "a", 2, 2, 30.0, True), (2, 0, 1.0, None, 2, 2, 30.0, True), (2, 1, 1.0, "a", 2, 2, 30.0, True), (3, 0, 1.0, None, None, 2, None, True), (3, 1, 1.0, None, None, 2, None, True)]
    got = media.consistency(spark.createDataFrame(parts, "folder int, part_idx long, duration_s double, codec string, width long, height long, fps double, probe_ok boolean"))
    assert {r.folder: r.direct_copy for r in got.collect()} == {1: True, 2: False, 3: True}
    assert "Expand" not in plan_of(got)


def test_contested_islands_need_no_group_of_frames(spark):
    segments = spark.createDataFrame([(1, i, i * 2.0, i * 2.0 + 1.0, "") for i in range(10)], "stream_id long, idx long, start_s double, end_s double, text string")
    anchors = spark.createDataFrame([(1, 5, 2), (1, 3, 6)], "stream_id long, match_ord long, idx long")
    nothing = segments.select("stream_id", "idx").where("false")
    got = cv.expand_anchors(anchors, spark.createDataFrame([(1, 0, 9)], "stream_id long, lo long, hi long"), nothing, segments, gap_s=9.0, cap_s=9.0)
    assert sorted((r.match_ord, r.idx) for r in got.collect()) == [(3, 3), (3, 4), (3, 5), (3, 6), (3, 7), (5, 0), (5, 1), (5, 2)]
    assert "FlatMapGroupsInPandas" not in plan_of(got)
