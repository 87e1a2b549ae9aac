"""Content types, the annotate hook, the older run and the evaluation, on small made streams."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import annotate as an, evaluation as ev, legacy as lg

SEG = "stream_id long, idx long, start_s double, end_s double, text string"
MEM = "stream_id long, match_ord long, title string, confidence double, idx long"


def stream(s, n, step=12.0):
    return [(s, i, i * step, i * step + 10.0, f"line {i}") for i in range(n)]


def items(*found):
    return json.dumps([{"title": t, "segment_indices": ids, "confidence": 0.8} for t, ids in found])


def test_registry():
    types = an.ContentTypes(an.ContentType("song"), an.ContentType("dialogue"))
    with pytest.raises(ValueError):
        types.register(an.ContentType("song"))
    with pytest.raises(KeyError, match="dialogue, song"):
        types.get("funny")
    assert types.names() == ["dialogue", "song"]
    assert [t.name for t in types.enabled({"content_types": {"song": True, "dialogue": False}})] == ["song"]


def test_two_types_through_a_callers_hook(spark):
    segments = spark.createDataFrame(stream(1, 7) + stream(2, 3), SEG)
    asked = []

    def annotate(requests):
        asked.append(requests.columns)
        # the caller's own code, a row at a time here: any DataFrame function will do
        def say(batches):
            for b in batches:
                b["raw"] = [None if r.stream_id == 2 and r.content_type == "b" else items((f"{r.content_type}{r.request}", [r.lo, r.hi]), ("", [1])) for r in b.itertuples()]
                yield b[[*an.REQUEST, "raw"]]

        return requests.mapInPandas(say, "content_type string, stream_id long, phase string, request long, raw string")

    types = [an.ContentType("a", "find a", 4), an.ContentType("b", "find b", 100, compose=lambda m, s: m.where("title <> 'b0' or idx > 0"))]
    got = sorted(tuple(r) for r in an.annotated(segments, types, annotate).collect())
    assert got == [("a", 1, 0, "a0", 0.8, 0), ("a", 1, 0, "a0", 0.8, 3), ("a", 1, 1, "a1", 0.8, 4), ("a", 1, 1, "a1", 0.8, 6), ("a", 2, 0, "a0", 0.8, 0), ("a", 2, 0, "a0", 0.8, 2), ("b", 1, 0, "b0", 0.8, 6)]
    assert len(asked) == 1
    first = an.transcript_requests(segments, types[0]).where("stream_id = 2").first()
    assert first.text == "[0] (0.0-10.0) line 0\n[1] (12.0-22.0) line 1\n[2] (24.0-34.0) line 2\n\nfind a"
    with pytest.raises(ValueError, match="raw"):
        an.ask(an.transcript_requests(segments, types[0]), lambda r: r)


def test_legacy_run(spark):
    """A conflict settled by the annotator, an over-long match redrawn, a missed range found, a second review that cannot be read."""
    segments = spark.createDataFrame(stream(1, 100), SEG)
    first = [("A", 0.9, range(2, 7)), ("B", 0.8, range(5, 9)), ("Long", 0.7, range(20, 60)), ("C", 0.6, range(70, 74)), ("未知歌曲：x", 0.95, range(72, 76))]
    members = spark.createDataFrame([(1, o, t, c, i) for o, (t, c, ids) in enumerate(first) for i in ids], MEM)
    answers = {
        ("review_before", 5): items(("A", [2, 3, 4, 5]), ("B", [6, 7, 8])), ("review_before", 73): items(("未知歌曲：y", [72])), ("review_before", 40): items(("Long", list(range(20, 60)))),
        ("overlong", 40): items(("One", list(range(20, 35))), ("Two", list(range(40, 60))), ("Out", [10])), ("missed", 85): items(("Found", list(range(80, 90))), ("Covered", [21])), ("review_after", 5): "no",
    }
    seen = []

    def annotate(requests):
        rows = requests.collect()
        seen.extend((r.phase, r.lo, r.hi) for r in rows)
        said = [(r.content_type, r.stream_id, r.phase, r.request, text) for r in rows for (phase, at), text in answers.items() if phase == r.phase and r.lo <= at <= r.hi]
        return spark.createDataFrame(said, "content_type string, stream_id long, phase string, request long, raw string")

    run = lg.legacy_run(members, segments, annotate, lg.Rules(context=1, chunk=50, pack=60))
    got = {}
    for r in run.members.orderBy("idx").collect():
        got.setdefault(r.title, []).append(r.idx)
    # A and B apart as answered; of C and the unnamed one C stays, as the answer loses its name; Long becomes One and Two
    assert got == {"A": [2, 3, 4, 5], "B": [6, 7, 8], "One": list(range(20, 35)), "Two": list(range(40, 60)), "C": [70, 71, 72, 73], "Found": list(range(80, 90))}
    audit = {r.stage: r for r in run.audit.collect()}
    assert [audit[s].asked for s in ("review_before", "overlong", "missed")] == [3, 1, 2]
    assert (audit["review_before"].taken, audit["overlong"].taken, audit["missed"].taken) == (2, 1, 1)
    assert ("overlong", 19, 60) in seen and any(p == "missed" for p, _, _ in seen)


def test_profile_metrics_and_gates(spark):
    segments = spark.createDataFrame(stream(1, 60) + stream(2, 5), SEG)
    truth = spark.createDataFrame([(1, 0, "a", 0.9, i) for i in range(0, 10)] + [(1, 1, "b", 0.9, i) for i in range(12, 22)] + [(1, 2, "low", 0.3, 50)], MEM)
    matches = [("a", range(0, 5)), ("A", range(5, 14)), ("a", range(0, 5)), ("未知歌曲：q", range(4, 6)), ("watched", range(20, 60))]
    members = spark.createDataFrame([(1, o, t, 0.5, i) for o, (t, ids) in enumerate(matches) for i in ids], MEM)
    usage = spark.createDataFrame([(1, 1_000_000, 1_000_000, 0)], "stream_id long, hit long, miss long, completion long")
    estimates = spark.createDataFrame([(1, 0.14)], "stream_id long, estimated_usd double")
    titles = spark.createDataFrame([("Watched",), ("b",)], "title string")
    m = ev.profile_metrics(members, segments, ev.weak_truth(truth), usage, estimates=estimates, protected=titles, watched=titles)
    r = {x.stream_id: x for x in m.collect()}
    a = r[1]
    assert (a.matches, a.unknown_titles, a.known_titles, a.exact_duplicates) == (5, 1, 4, 1)
    assert (a.same_title_overlaps, a.different_title_overlaps) == (1, 3)
    assert (a.anchors, a.anchor_hits, a.title_agreements, a.fragmented_anchors, a.coalesced_anchors, a.mixed_title_coalesced) == (2, 1, 1, 2, 1, 1)
    assert a.overlong_regressions == 1 and a.protected_found == 1 and a.duration_outliers == 5
    assert a.coverage_precision == 14 / 54 and a.coverage_recall == 14 / 20 and a.cache_hit_ratio == 0.5
    assert abs(a.cost_usd - 0.1428) < 1e-12 and a.estimate_valid
    assert r[2].matches == 0 and r[2].anchor_recall is None and r[2].coverage_precision is None and r[2].estimate_error is None
    base = ev.profile_metrics(truth, segments, ev.weak_truth(truth), usage)
    g = {x.stream_id: x.asDict() for x in ev.gates(m, base).collect()}
    assert not any(g[1].values()) or {k for k, v in g[1].items() if v} == {"stream_id"}
    assert {k for k, v in g[2].items() if v} == {"stream_id", *ev.GATES[3:]}
    best = ev.best_profiles(ev.gates(base, base).withColumn("profile", F.lit("p")), base.withColumn("profile", F.lit("p")))
    assert best.count() == 0
