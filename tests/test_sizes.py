"""Steps that once failed at size: what they give, and that nothing large is left in their plans."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spanloom.operators import matches as mt, naming as nm
from spanloom.operators.components import components_within
from spanloom.plans import io_queries as io
from spanloom.sources import readers as rd
from spanloom.sources.checkpoints import by_stream


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_times_that_overlap_are_no_gap(spark):
    """Two matches of a title apart by index whose times overlap: a gap of nothing, which -1 does not allow and 0 does."""
    segments = spark.createDataFrame([(1, 0, 0.0, 50.0, "a"), (1, 1, 10.0, 12.0, "b"), (1, 2, 20.0, 22.0, "c")], "stream_id long, idx long, start_s double, end_s double, text string")
    members = spark.createDataFrame([(1, 0, "x", 0.5, 0), (1, 1, "x", 0.5, 2)], "stream_id long, match_ord long, title string, confidence double, idx long")
    groups = lambda gap: {r.match_ord for r in mt.merge_same_title(members, segments, gap).collect()}
    assert groups(-1.0) == {0, 1}
    assert groups(0.0) == {0}


def test_recovered_titles_of_stems_that_hold_several_beginnings(spark):
    """The first listed counts, or the first in the stem; a folder's files and titles are not paired."""
    titles = spark.createDataFrame([(0, 1, "2345 b"), (0, 2, "1234 a"), (0, 3, ""), (0, 4, "ab"), (0, 9, "nine"), (1, 5, "1234 other")], "folder int, index long, title string")
    files = spark.createDataFrame([(0, "12345-\ufffd"), (0, "x1234\ufffd"), (0, "9-\ufffd"), (0, "7 ab\ufffd"), (0, "7-\ufffd"), (0, "12345")], "folder int, stem string")
    listed = {"x1234\ufffd": "1234 a", "9-\ufffd": "nine", "7 ab\ufffd": "ab", "7-\ufffd": None, "12345-\ufffd": "2345 b"}
    assert {r.stem: r.title for r in nm.recover_titles(files, titles).collect()} == listed
    assert {r.stem: r.title for r in nm.recover_titles(files, titles, by_place=True).collect()} == listed | {"12345-\ufffd": "1234 a"}


def test_rebased_numbers_through_all_chunks_without_a_window(spark):
    chunk = "array<struct<chunk:long,from_s:double,segments:array<struct<idx:long,start_s:double,end_s:double,text:string>>>>"
    lists = [(1, [(1, 10.0, [(1, 4.0, 5.0, "d"), (0, 0.0, 3.0, "c")]), (0, 0.0, [(0, 1.0, 2.0, "a"), (3, 2.0, 9.0, "b")])]), (2, [(0, 0.0, []), (1, 10.0, [(0, 0.5, 1.0, "e")])])]
    got = rd.rebased(spark.createDataFrame(lists, f"stream_id long, chunks {chunk}"))
    assert rows(got) == [(1, 0, 1.0, 2.0, "a"), (1, 1, 2.0, 9.0, "b"), (1, 2, 10.0, 13.0, "c"), (1, 3, 14.0, 15.0, "d"), (2, 0, 10.5, 11.0, "e")]
    grid = spark.createDataFrame([(s, c, c * 10.0) for s in (1, 2) for c in (0, 1)], "stream_id long, chunk long, from_s double")
    flat = spark.createDataFrame([(s, c, *x) for s, cs in lists for c, _, xs in cs for x in xs], "stream_id long, chunk long, idx long, start_s double, end_s double, text string")
    assert rows(rd.rebase(flat, grid)) == rows(got)
    assert "Window" not in plan_of(got) and "Exchange" not in plan_of(got)


def test_chunks_begin_every_so_many_seconds(spark):
    got = spark.range(1).select(F.explode(rd.chunk_starts(F.lit(21.0), 10.0)).alias("c")).select("c.*")
    assert rows(got) == [(0, 0.0), (1, 10.0), (2, 20.0)]


def test_logs_and_transcripts_take_few_files(spark, tmp_path, monkeypatch):
    """Not one for each of a thousand streams."""
    monkeypatch.setattr(io, "_scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(io, "segments", lambda spark, d: spark.range(2000).select((F.col("id") % 1000).alias("stream_id"), F.floor(F.col("id") / 1000).alias("idx"), F.lit("a").alias("text")))
    monkeypatch.setattr(io, "transcripts", lambda spark, d: io.segments(spark, d).select("*", F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s")))
    assert len(io.q_responses(spark, "").collect()) == 1000
    assert len(io.q_read_segments(spark, "").collect()) == 2000
    files = lambda name: [p for p in (tmp_path / name).rglob("*") if p.is_file() and p.name.startswith("part-")]
    assert len(files("logs")) <= 2 * io.FOLDERS
    assert len(files("transcripts")) < 100


def test_pairs_that_cannot_be_like_are_not_scored(spark):
    """The bound lets pass whatever the ratio or containment would find, and the best alias stays that of all pairs."""
    import difflib
    import random

    rng = random.Random(5)
    names = [f"supplier#{k:05d}" for k in range(40)] + ["abcdefgh", "ab", "abc", "live2"]
    texts = ["".join(c for c in rng.choice(names) if rng.random() > 0.1) or "q" for _ in range(80)] + ["live19960102", "xsupplier#00007", "none"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in texts], "a string, b string").withColumn("may", nm._may_be_like(F.col("a"), F.col("b")))
    refused = [r for r in pairs.collect() if not r.may]
    assert any(r.b == "live19960102" for r in refused) and all(difflib.SequenceMatcher(None, r.a, r.b).ratio() < 0.8 for r in refused)
    dictionary = spark.createDataFrame([(k, f"S{k}", 0, a) for k, a in enumerate(names)], "entry_ord long, streamer string, alias_ord int, alias string")
    paths = spark.createDataFrame([(k, [t]) for k, t in enumerate(texts)], "key long, texts array<string>")
    folded = {t: r.t for t, r in zip(texts, spark.createDataFrame([(t,) for t in texts], "x string").select(nm.match_text(F.col("x")).alias("t")).collect())}

    def likeness(a, b):
        inside = (a in b or b in a) and min(len(a), len(b)) / max(len(a), len(b)) >= 0.45
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        return 1.0 if a == b else max(0.92, ratio) if inside else ratio

    aliases = [r.t for r in spark.createDataFrame([(a,) for a in names], "x string").select(nm.match_text(F.col("x")).alias("t")).collect()]
    got = {r.key: (r.streamer, r.score) for r in nm.resolve_streamers(paths, dictionary).collect()}
    for k, t in enumerate(texts):
        score, entry = max((likeness(a, folded[t]), -e) for e, a in enumerate(aliases))
        if score >= 0.8:
            assert got[k] == (f"S{-entry}", score)
        else:
            assert got[k][0] == "unknown"


def keys_of_moves(df) -> set[str]:
    """By which columns rows are dealt in the plan."""
    return set(re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", re.sub(r"#\d+L?", "", plan_of(df))))


def test_what_is_kept_by_stream_is_dealt_once(spark):
    members = by_stream(spark.createDataFrame([(s, m, f"t{m % 2}", 0.5, m + k) for s in (1, 2) for m in range(8) for k in range(3)], "stream_id long, match_ord long, title string, confidence double, idx long"))
    for df in (mt.heads(members), mt.drop_duplicates(members).groupBy("stream_id").count()):
        assert "stream_id" in keys_of_moves(df)
    assert keys_of_moves(mt.heads(members)) == {"stream_id"}


def test_clusters_stay_within_their_stream(spark):
    edges = spark.createDataFrame([(1, 3, 1), (1, 3, 4), (2, 4, 5), (2, 5, 5), (3, 9, 8), (3, 8, 7)], "stream_id long, a long, b long")
    got = components_within(edges, "stream_id")
    assert rows(got) == [(1, 1, 1), (1, 3, 1), (1, 4, 1), (2, 4, 4), (2, 5, 4), (3, 7, 7), (3, 8, 7), (3, 9, 7)]
    assert keys_of_moves(got) == {"stream_id"}
