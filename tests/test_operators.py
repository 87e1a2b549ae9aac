"""Operators on small hand-made fixtures with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import clips, coverage, intervals as iv, matches as mt, naming, protocol, responses, review, usage
from spanloom.functions import scalars as sc
from spanloom.sources import readers


def segs(spark, spans, stream=1, texts=None):
    rows = [(stream, i, float(a), float(b), texts[i] if texts else f"s{i}") for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, "stream_id long, idx long, start_s double, end_s double, text string")


def mems(spark, matches, stream=1):
    rows = [(stream, k, title, conf, i) for k, (title, conf, ids) in enumerate(matches) for i in ids]
    return spark.createDataFrame(rows, "stream_id long, match_ord long, title string, confidence double, idx long")


def padding(**kw):
    base = dict(before=15.0, after=15.0, guard=2.0, shortest=1.0, cap=360.0, gap=20.0, adaptive=False)
    return clips.Padding(**(base | kw))


def times(df):
    return sorted((round(r.start_s, 6), round(r.end_s, 6)) for r in df.collect())


def with_total(spark, spans, total):
    """The stream's end is that of its last segment, so a last segment stands for the total where none is near."""
    return segs(spark, spans)


def test_neighbour_guard(spark):
    s = segs(spark, [(90, 95), (100, 110), (130, 135), (149, 150)])
    assert times(clips.build_clips(s, mems(spark, [("A", 0.9, [1])]), padding())) == [(92.0, 125.0)]


def test_silence_padding(spark):
    s = segs(spark, [(0, 2), (54, 60), (120, 122), (139, 140)])
    p = padding(adaptive=True, threshold=25.0, ratio=0.5, before_max=45.0, after_max=45.0)
    assert times(clips.build_clips(s, mems(spark, [("A", 0.9, [1])]), p)) == [(28.0, 90.0)]


def test_silence_padding_cap(spark):
    s = segs(spark, [(0, 2), (120, 130), (149, 150)])
    p = padding(adaptive=True, threshold=25.0, ratio=0.8, before_max=45.0, after_max=45.0)
    assert times(clips.build_clips(s, mems(spark, [("A", 0.9, [1])]), p))[0][0] == 75.0


def test_merge_cap_and_gap_split(spark):
    bare = padding(before=0.0, after=0.0, guard=0.0)
    two = segs(spark, [(0, 180), (190, 370)])
    assert times(clips.build_clips(two, mems(spark, [("A", 0.9, [0]), ("A", 0.9, [1])]), bare)) == [(0.0, 180.0), (190.0, 370.0)]
    four = segs(spark, [(0, 100), (100, 180), (500, 620), (620, 700)])
    assert times(clips.build_clips(four, mems(spark, [("A", 0.9, [0, 1, 2, 3])]), bare)) == [(0.0, 180.0), (500.0, 700.0)]


def test_numbers_keep_gaps_and_odd_rows(spark):
    s = segs(spark, [(0, 5), (100, 300), (400, 402)])
    m = mems(spark, [("A", 0.9, [0]), ("B", 0.9, [1]), ("C", 0.9, [2, 77])])
    out = clips.build_clips(s, m, padding(before=0.0, after=0.0, guard=0.0, shortest=50.0)).collect()
    assert [(r.clip_index, r.title) for r in out] == [(2, "B")]
    assert clips.build_clips(s, m.where("false"), padding()).count() == 0


def test_fold_equals_plain_fold(spark):
    rng = random.Random(3)
    for trial in range(3):
        spans, t = [], 0.0
        for _ in range(120):
            t += rng.choice([1, 5, 30])
            spans.append((t, t + rng.choice([2, 10])))
            t += 2
        matches = [(rng.choice("AB"), rng.random(), sorted(rng.sample(range(120), rng.randint(1, 4)))) for _ in range(40)]
        parts = iv.hulls(iv.split_at_gaps(mems(spark, matches), segs(spark, spans), 20.0))
        rows = sorted((r.start_s, r.match_ord, r.part, r.end_s, r.lo, r.hi, r.title) for r in parts.collect())
        want = []
        for s, _, _, e, lo, hi, title in rows:
            p = want[-1] if want else None
            if p and ((lo <= p[3] and hi >= p[2]) or (s - p[1] <= 20 and title == p[4])) and max(e, p[1]) - min(s, p[0]) <= 200:
                p[1], p[2], p[3] = max(p[1], e), min(p[2], lo), max(p[3], hi)
                p[4] = title if len(title) > len(p[4]) else p[4]
            else:
                want.append([s, e, lo, hi, title])
        got = sorted([r.start_s, r.end_s, r.lo, r.hi, r.title] for r in clips.merge_adjacent(parts, 20.0, 200.0).collect())
        assert got == sorted(want), trial


def test_ranges_and_windows(spark):
    s = segs(spark, [(i * 10, i * 10 + 5) for i in range(6)])
    free = iv.uncovered(s, mems(spark, [("A", 0.9, [1, 2]), ("B", 0.9, [4])]))
    assert sorted((r.lo, r.hi) for r in free.collect()) == [(0, 0), (3, 3), (5, 5)]
    ranges = spark.createDataFrame([(1, 0, 4), (1, 8, 9)], "stream_id long, lo long, hi long")
    assert sorted((r.lo, r.hi) for r in iv.chunked(ranges, 2).collect()) == [(0, 1), (2, 3), (4, 4), (8, 9)]
    wide = spark.createDataFrame([(1, 0, 20), (1, 40, 60), (1, 490, 499), (1, 500, 520)], "stream_id long, lo long, hi long")
    assert [r.window for r in iv.packed(wide, 500).orderBy("lo").collect()] == [0, 0, 0, 1]
    counted = spark.createDataFrame([(1, 0, 5, 3), (1, 10, 15, 3), (1, 700, 701, 1)], "stream_id long, lo long, hi long, n long")
    assert [r.window for r in iv.packed(counted, 500, 6).orderBy("lo").collect()] == [0, 0, 1]


def test_clusters_and_selection(spark):
    m = mems(spark, [("A", 0.9, [1, 2]), ("B", 0.8, [2, 3]), ("C", 0.9, [8, 9])])
    s = segs(spark, [(i * 10, i * 10 + 8) for i in range(12)])
    none = mt.heads(m).where("false").select("stream_id", "match_ord")
    cl = mt.clusters(mt.conflict_edges(m, none), none)
    assert {(r.match_ord, r.cluster) for r in cl.collect()} == {(0, 0), (1, 0)}
    best = mt.select_best(m, cl, s, spark.createDataFrame([], "title string"), 360.0)
    assert {r.match_ord: r.action for r in best.collect()} == {0: "keep", 1: "discard"}
    near = mems(spark, [("A", 0.9, [999, 1002]), ("B", 0.9, [1003, 1059]), ("C", 0.9, [1200, 1250])])
    edges = mt.conflict_edges(near, none, nearby=2).collect()
    assert [(r.a, r.b) for r in edges] == [(0, 1)]
    known = mems(spark, [("未知歌曲：x", 0.95, [0, 1]), ("A", 0.9, [0, 1])])
    cl = mt.clusters(mt.conflict_edges(known, none), none)
    kept = mt.select_best(known, cl, s, spark.createDataFrame([], "title string"), 360.0).where("action = 'keep'").collect()
    assert [r.match_ord for r in kept] == [1]


def test_suspicious_same_title_span(spark):
    m = mems(spark, [("A", 0.9, [10, 11]), ("A", 0.9, [20, 21]), ("A", 0.9, [800, 801])])
    sus = mt.heads(m).select("stream_id", "match_ord")
    got = mt.clusters(mt.conflict_edges(m, sus, span=100), sus)
    assert {r.match_ord: r.cluster for r in got.collect()} == {0: 0, 1: 0, 2: 2}


def test_risk_cases(spark):
    s = segs(spark, [(i * 10, i * 10 + 8) for i in range(10)])
    r = mt.risks(mems(spark, [("A", 0.9, list(range(10)))]), s).collect()[0]
    assert r.action == "review" and "duration_below_soft_range" in r.reasons
    s = segs(spark, [(i * 10, i * 10 + 9) for i in range(20)])
    r = mt.risks(mems(spark, [("unknown", 0.9, list(range(20)))]), s).collect()[0]
    assert r.action == "accept" and r.reasons == ["unknown_title"]


def test_same_title_merges(spark):
    s = segs(spark, [(0, 10), (12, 22), (50, 60), (62, 72)])
    m = mems(spark, [("A", 0.9, [0]), ("A", 0.8, [1]), ("B", 0.7, [2, 3])])
    got = sorted((r.title, r.lo, r.hi) for r in mt.heads(mt.merge_same_title(m, s, 20.0)).collect())
    assert got == [("A", 0, 1), ("B", 2, 3)]
    blocked = mems(spark, [("A", 0.9, [0]), ("B", 0.8, [1]), ("A", 0.7, [2])])
    assert mt.heads(mt.merge_same_title(blocked, s, 100.0)).count() == 2
    assert mt.heads(mt.merge_same_title(blocked, s, 100.0, neighbours_only=True)).count() == 3


def test_anchor_expansion(spark):
    s = segs(spark, [(0, 5), (6, 10), (11, 15), (30, 35)])
    a = spark.createDataFrame([(1, 0, 1)], "stream_id long, match_ord long, idx long")
    whole = spark.createDataFrame([(1, 0, 3)], "stream_id long, lo long, hi long")
    none = a.where("false").select("stream_id", "idx")
    got = coverage.expand_anchors(a, whole, none, s, gap_s=8.0, cap_s=360.0)
    assert sorted(r.idx for r in got.collect()) == [0, 1, 2]
    s = segs(spark, [(i * 6, i * 6 + 5) for i in range(5)])
    a = spark.createDataFrame([(1, 0, 3)], "stream_id long, match_ord long, idx long")
    held = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "stream_id long, idx long")
    whole = spark.createDataFrame([(1, 0, 4)], "stream_id long, lo long, hi long")
    got = coverage.expand_anchors(a, whole, held, s, gap_s=8.0, cap_s=360.0)
    assert sorted(r.idx for r in got.collect()) == [3, 4]


def test_temporal_cases(spark):
    t, src = mems(spark, [("未知歌曲：t", 0.9, [9, 10, 11, 12, 13])]), mems(spark, [("A", 0.7, [10, 11, 12]), ("Z", 0.8, [20, 21]), ("Y", 0.5, [30])])
    got = sorted((r.origin, r.title, round(r.confidence, 3)) for r in mt.restore_titles(t, src).collect())
    assert got == [("source", "Z", 0.8), ("temporal", "A", 0.9)]
    t = mems(spark, [("T", 0.9, list(range(10, 30)))])
    two = mems(spark, [("A", 0.9, list(range(10, 20))), ("B", 0.9, list(range(20, 30)))])
    assert sorted((r.lo, r.hi) for r in mt.split_at_sources(t, two).collect()) == [(10, 19), (20, 29)]
    same = mems(spark, [("A", 0.9, list(range(10, 20))), ("A", 0.9, list(range(20, 30)))])
    assert [(r.lo, r.hi) for r in mt.split_at_sources(t, same).collect()] == [(10, 29)]


@pytest.mark.parametrize("decs, reason", [
    ([(0, "accept", "P001", 1, 5), (1, "reject", "R001", None, None)], None), ([(0, "accept", "P001", 1, 5)], "missing_id"),
    ([(0, "accept", "P001", 1, 5), (1, "accept", "P001", 1, 2), (2, "reject", "R001", None, None)], "duplicate_id"), ([(0, "accept", "X", 1, 5)], "unknown_id"),
    ([(0, "merge", "P001", 1, 5)], "invalid_merge"), ([(0, "reject", "P001", 1, 5)], "reject_has_ranges"), ([(0, "guess", "P001", 1, 5)], "invalid_action"),
])
def test_adjudication_rules(spark, decs, reason):
    d = spark.createDataFrame([(1, *x, 0.9) for x in decs], "stream_id long, dec long, action string, id string, lo long, hi long, confidence double")
    c = spark.createDataFrame([(1, "P001"), (1, "R001")], "stream_id long, id string")
    assert protocol.adjudication_reason(d, c).collect()[0].reason == reason


def test_storm(spark):
    s = segs(spark, [(i * 3, i * 3 + 2) for i in range(3211)])
    many = mems(spark, [("A", 0.9, [i]) for i in range(1398)])
    assert usage.storm(many, s).collect()[0].storm
    few = mems(spark, [("A", 0.9, list(range(i * 100, i * 100 + 31))) for i in range(20)])
    assert not usage.storm(few, s).collect()[0].storm


def test_responses(spark):
    raw = ['[{"title": "A", "segment_indices": [1, "2", true, 2]}, 5, {"title": " "}]', '```json\n[{"title": "B", "segment_indices": [3], "confidence": 7}]\n```', 'x [{"title": "C", "segment_indices": [4]}, {"title": "D", "segm', "", None, "[]"]
    df = spark.createDataFrame(list(enumerate(raw)), "stream_id long, raw string")
    got = sorted((r.stream_id, r.title, r.indices, r.confidence, r.recovered) for r in responses.items(df, ["stream_id"]).collect())
    assert got == [(0, "A", [1, 2], 0.5, False), (1, "B", [3], 1.0, False), (2, "C", [4], 0.5, True)]
    assert [r.status for r in responses.parsed(df).orderBy("stream_id").collect()] == ["ok", "ok", "failed", "empty", "empty", "ok"]


def test_thinning(spark):
    got = protocol.thin(mems(spark, [("A", 0.9, list(range(100)))]), 12)
    ids = sorted(r.idx for r in got.collect())
    assert len(ids) <= 12 and ids[0] == 0 and ids[-1] == 99


def test_dates_and_names(spark):
    row = spark.range(1).select(
        sc.valid_date(F.lit("260603")).alias("a"), sc.valid_date(F.lit("261399")).alias("b"), sc.date_in(F.lit("2026_06_03")).alias("c"), sc.date_in(F.lit("live_250603_cut")).alias("d"),
        sc.parse_time(F.lit("1:02:03")).alias("e"), sc.parse_time(F.lit(None).cast("string")).alias("f"), sc.fraction(F.lit("30000/1001")).alias("g"), sc.fraction(F.lit("0/0")).alias("h"),
        sc.log_segments(F.lit("segment(s) 1, 3")).alias("i"), sc.log_problems(F.lit("Invalid NAL unit")).alias("j"), naming.similarity(F.lit("abc"), F.lit("abd")).alias("k"),
    ).collect()[0]
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (True, False, "260603", "250603", 3723.0, 0.0)
    assert abs(row.g - 29.97) < 0.01 and row.h is None and row.i == [0, 2] and row.j == ["bitstream_corruption"] and abs(row.k - 2 / 3) < 1e-9


def test_clusters_of_a_long_chain(spark):
    from spanloom.operators.matches import clusters

    rows = [(s, i, i + 1) for s in (1, 2) for i in range(1, 140)] + [(3, 5, 9)]
    edges = spark.createDataFrame(rows, "stream_id long, a long, b long")
    alone = spark.createDataFrame([(1, 500), (3, 9), (4, 1)], "stream_id long, match_ord long")
    got = sorted(map(tuple, clusters(edges, alone).collect()))
    assert got == sorted([(s, i, 1) for s in (1, 2) for i in range(1, 141)] + [(3, 5, 5), (3, 9, 5), (1, 500, 500), (4, 1, 1)])
    with pytest.raises(RuntimeError):
        clusters(edges, alone, max_rounds=1)


def test_names_against_plain_scores(spark):
    import difflib
    import random
    import re
    import unicodedata

    from spanloom.operators import naming

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeＡé ") for _ in range(rng.randint(1, 9)))
    aliases = [word() for _ in range(40)] + ["ab", "ABC", "Ｓｔｒａße"]
    texts = [[rng.choice(aliases) + rng.choice(["", "x", " live"]) if rng.random() < 0.6 else word() for _ in range(3)] for _ in range(60)] + [["axb", ""], ["strasse"], [""]]
    plain = lambda x: re.sub(naming.IGNORED, "", unicodedata.normalize("NFKC", x).casefold().strip())

    def like(x, y):
        x, y = plain(x), plain(y)
        if not x or not y:
            return 0.0
        r = 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
        return max(0.92, r) if x != y and (x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) >= 0.45 else r

    paths = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, texts array<string>")
    dictionary = spark.createDataFrame([(i, f"S{i}", 0, a) for i, a in enumerate(aliases)], "entry_ord long, streamer string, alias_ord long, alias string")
    got = {r.key: (r.streamer, r.score) for r in naming.resolve_streamers(paths, dictionary).collect()}
    for i, ts in enumerate(texts):
        score, entry = max((like(a, t), -e) for e, a in enumerate(aliases) for t in ts)
        if score >= 0.8:
            assert got[i] == (f"S{-entry}", score), (i, ts, score)
        else:
            assert got[i][0] == "unknown" and got[i][1] <= score


def test_chorus_context_against_plain_reading(spark):
    import random

    from spanloom.operators import coverage

    rng = random.Random(5)
    segs, mem = [], []
    for s in range(30):
        at = 0.0
        for i in range(40):
            at += rng.choice([1, 1, 30, 90, 200])
            segs.append((s, i, at, at + 2, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 3)))))
            at += 2
            if rng.random() < 0.8:
                mem.append((s, 1, "t", 0.9, i))
    segments = spark.createDataFrame(segs, "stream_id long, idx long, start_s double, end_s double, text string")
    members = spark.createDataFrame(mem, "stream_id long, match_ord long, title string, confidence double, idx long")
    got = {(r.stream_id, r.idx): r.part for r in coverage.split_by_chorus(members, segments, 10.0, 120.0).collect()}
    by = {(s, i): (a, b, set(t.split())) for s, i, a, b, t in segs}
    for s in range(30):
        own = [i for x, _, _, _, i in mem if x == s]
        part, group = 0, own[:1]
        assert got[s, own[0]] == 0
        for k in range(1, len(own)):
            gap = by[s, own[k]][0] - by[s, own[k - 1]][1]
            x = set().union(*(by[s, i][2] for i in group[-3:]))
            y = set().union(*(by[s, i][2] for i in own[k : k + 3]))
            same = len(x & y) / min(len(x), len(y)) >= 0.3 if x and y else False
            if gap > 120 or (gap > 10 and not same):
                part, group = part + 1, []
            group.append(own[k])
            assert got[s, own[k]] == part


def test_anchor_expansion_against_plain_growth(spark):
    """Islands of one and of several anchors, against growth of one anchor after the other over the whole stream."""
    rng = random.Random(5)
    at, spans = 0.0, []
    for _ in range(300):
        at += rng.choice([0.0, 1.0, 3.0, 30.0])
        spans.append((at, at + rng.randint(1, 6)))
        at = spans[-1][1]
    held = {i for i in range(300) if rng.random() < 0.05}
    owner = {i: k for k, i in enumerate(sorted(rng.sample([i for i in range(300) if i not in held], 40)))}
    cap, gap, claimed = 25.0, 8.0, {}
    joined = lambda a, b: a in range(300) and b in range(300) and not {a, b} & held and spans[max(a, b)][0] - spans[min(a, b)][1] <= gap
    for place, seed in sorted(owner.items(), key=lambda x: x[1]):
        low = high = place
        free = lambda i: i not in claimed and owner.get(i, seed) == seed  # noqa: B023, E731
        while joined(low - 1, low) and free(low - 1) and spans[high][1] - spans[low - 1][0] <= cap:
            low -= 1
        while joined(high, high + 1) and free(high + 1) and spans[high + 1][1] - spans[low][0] <= cap:
            high += 1
        for i in range(low, high + 1):
            claimed.setdefault(i, seed)
    a = spark.createDataFrame([(1, k, i) for i, k in owner.items()], "stream_id long, match_ord long, idx long")
    whole = spark.createDataFrame([(1, 0, 299)], "stream_id long, lo long, hi long")
    blocked = spark.createDataFrame([(1, i) for i in held], "stream_id long, idx long")
    got = coverage.expand_anchors(a, whole, blocked, segs(spark, spans), gap_s=gap, cap_s=cap).collect()
    assert {r.idx: r.match_ord for r in got} == claimed and len(got) == len(claimed)


def test_response_logs_by_manifest(spark, tmp_path):
    folder = tmp_path / "logs" / "a"
    folder.mkdir(parents=True)
    for name, raw in (("r1.json", "[1]"), ("r2.json", "[2]"), ("r3.json", "[3]")):
        (folder / name).write_text(json.dumps({"stream_id": "s", "phase": "main", "raw": raw, "finish_reason": "stop"}))
    (folder / "broken.json").write_text('{"stream_id": "s", "ra')
    (folder / "manifest.json").write_text(json.dumps({"files": ["r1.json", "r3.json", "broken.json", "gone.json"]}))
    got = readers.read_responses(spark, str(tmp_path / "logs")).collect()
    assert sorted(r.raw for r in got) == ["[1]", "[3]"]


def test_clip_list_from_csv(spark, tmp_path):
    (tmp_path / "clips.csv").write_text("\ufeffindex,start,end,title,artist,tags\n1,0:10,0:20,Song,,a|b\n,30,20,,x,\n", encoding="utf-8")
    rows = sorted(readers.read_clip_list(spark, str(tmp_path / "clips.csv")).collect(), key=lambda r: r.start_s)
    assert [(r.start_s, r.end_s, r.title, r.tags, r.rejected) for r in rows] == [(10.0, 20.0, "Song", ["a", "b"], False), (30.0, 20.0, "untitled", [], True)]
    assert rows[0].row == 1


def test_response_spans(spark):
    texts = ["", "no json", '[{"title": "A", "segment_indices": [1]}]', 'so: {"a": [1]} end', '```json\n[{"title": "B", "segment_indices": [2]}]\n```', 'x [{"title": "C", "segment_indices": [3]}, {"tit']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, raw string")
    assert [r.status for r in responses.parsed(df).orderBy("k").collect()] == ["empty", "failed", "ok", "ok", "ok", "failed"]
    got = responses.items(df, ["k"]).orderBy("k").collect()
    assert [(r.k, r.title, list(r.indices), r.recovered) for r in got] == [(2, "A", [1], False), (4, "B", [2], False), (5, "C", [3], True)]


def test_final_additions(spark):
    """An addition needs its mark, a final range, and two segments or ten seconds of evidence; ranges are cut to the stream."""
    s = segs(spark, [(0, 5), (6, 10), (11, 25), (30, 35)])
    rows = [
        ("A", True, 0, 1, 0, 2), ("B", True, 2, 2, 2, 3), ("C", True, 3, 3, 3, 3), ("D", False, 0, 3, 0, 3), ("E", True, 9, 12, 0, 1), ("F", True, 3, 9, 2, 9),
    ]
    schema = "stream_id long, add long, anchor string, final_discovery boolean, kind string, lo long, hi long, confidence double"
    flat = [(1, k, a, f, kind, lo, hi, 0.7) for k, (a, f, elo, ehi, lo_, hi_) in enumerate(rows) for kind, lo, hi in (("evidence", elo, ehi), ("final", lo_, hi_))]
    adds = spark.createDataFrame(flat, schema)
    got = {r.anchor: r.enough for r in protocol.additions_with_evidence(adds, s).collect()}
    assert got == {"A": True, "B": True, "C": False, "D": False, "E": False, "F": False}
    decs = spark.createDataFrame([(1, 4, "accept", "P001", 3, 3, 0.9)], "stream_id long, dec long, action string, id string, lo long, hi long, confidence double")
    cands = spark.createDataFrame([(1, "P001", "x")], "stream_id long, id string, anchor string")
    final = protocol.apply_decisions(decs, cands, adds, s)
    assert sorted((r.match_ord, r.title, r.idx) for r in final.collect()) == [(4, "未知歌曲：x", 3), (5, "未知歌曲：A", 0), (5, "未知歌曲：A", 1), (5, "未知歌曲：A", 2), (6, "未知歌曲：B", 2), (6, "未知歌曲：B", 3)]
    done = spark.createDataFrame([(1, True), (2, False)], "stream_id long, complete boolean")
    reason = lambda a, **kw: {r.stream_id: r.reason for r in protocol.adjudication_reason(decs, cands, a, s, done, **kw).collect()}
    assert reason(adds) == {1: "addition_without_evidence", 2: "incomplete"}
    assert reason(adds.where("add < 2")) == {1: None, 2: "incomplete"}
    assert reason(adds.where("add < 2"), most_additions=1)[1] == "too_many_additions"


def test_containing_keys_against_plain(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab歌") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    a, b = words[::2], words[1::2] + ["", "歌"]
    keys = lambda x: spark.createDataFrame([(w,) for w in set(x)], "key string")
    got = {(r.outer, r.inner) for r in mt.containing(keys(a), keys(b)).collect()}
    assert got == {(x, y) for x in a for y in b if y in x}


def test_ranges_inside_targets_against_plain(spark):
    rng = random.Random(8)
    make = lambda n, most: [(s, lo, lo + rng.randint(0, most)) for s in (1, 2) for lo in (rng.randint(0, 60) for _ in range(n))]
    ranges, targets = make(40, 8), make(15, 12)
    df = lambda rows: spark.createDataFrame(rows, "stream_id long, lo long, hi long")
    got = {tuple(r) for r in review.inside_targets(df(ranges), df(targets)).collect()}
    assert got == {r for r in ranges if any(t[0] == r[0] and t[1] <= r[1] and r[2] <= t[2] for t in targets)}


def test_query_texts(spark):
    s = segs(spark, [(i, i + 1) for i in range(9)], texts=["aaa", "b", "ccc", " ddd ", "eee", "fff", "ggg", "hhh", "x" * 200])
    m = mems(spark, [("A", 0.9, range(8)), ("B", 0.9, [0]), ("C", 0.9, [0]), ("D", 0.9, [1]), ("E", 0.9, [8])])
    rows = [(1, 0, "abcd", ""), (1, 1, "a line of it", "told"), (1, 2, None, "[严重程度:2/5][场景:B] a scene"), (1, 3, "", None), (1, 4, None, None)]
    got = naming.query_texts(spark.createDataFrame(rows, "stream_id long, match_ord long, snippet string, description string"), m, s)
    assert {r.match_ord: r.query for r in got.collect()} == {0: "ccc ddd eee fff ggg", 1: "a line of it", 2: "a scene", 3: "", 4: "x" * 100}


def test_log_problems_try_patterns_only_where_a_mark_stands(spark):
    from spanloom.functions import scalars as sc

    texts = [
        "H264_MP4TOANNEXB filter\nfailed", "h264_mp4toannexb: Failed", "decode_slice_header x, pts is invalid", "no framework", "NO FRAME!", "scripts\ninvalid", "non monotonic", "monotonic", "AAC: error\nmoov atom not found", "encoder not found", "encoder not found: failed",
        "Concat output duration is too short: 3s, segment(s) 4, 2", "", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sc.log_problems(F.col("t")).alias("p"), sc.log_segments(F.col("t")).alias("s"), sc.failed_duration(F.col("t")).alias("f"))
    got = [(r.p, r.s, r.f) for r in rows.orderBy("i").collect()]
    bit, time = "bitstream_corruption", "timestamp_discontinuity"
    want = [[], [bit], [bit, time], [], [bit], [], [time], [], ["audio_decode_fail", "demux_error"], [], ["hw_unavailable"], ["duration_truncated"], [], []]
    assert [g[0] for g in got] == want
    assert got[11][1:] == ([1, 3], 3.0) and got[12][1:] == ([], None) and got[13][1:] == (None, None)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(t" in plan and "lambdafunction(isnotnull(namedlambda" not in plan
