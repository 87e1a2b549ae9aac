"""The three-round run, normalisation by both rules, boundary risk, page titles and search verification, on small made streams."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.scalars import page_title
from spanloom.operators import clips, intervals as iv, matches as mt, naming as nm, rounds as rd, stages as st

SEG = "stream_id long, idx long, start_s double, end_s double, text string"
MEM = "stream_id long, match_ord long, title string, confidence double, idx long"


def stream(s, n, step=12.0, texts=None):
    return [(s, i, i * step, i * step + 10.0, texts[i] if texts else f"line {i}") for i in range(n)]


@pytest.fixture(scope="module")
def rounds(spark):
    """Streams: 1 good, 2 discovery incomplete, 3 recall outside its target, 4 adjudication guesses, 5 no answers to recall, 6 without candidates."""
    segments = spark.createDataFrame([r for s in range(1, 7) for r in stream(s, 40)], SEG)
    ranges = [(s, 1, 2, 6, 0.9, " la la ") for s in range(1, 6)] + [(s, 2, 10, 99, 0.8, None) for s in range(1, 6) if s != 1] + [(1, 2, 10, 14, 0.8, None), (1, 3, 2, 6, 0.1, "again")]
    discovery = [(s, s != 2, 2 if s < 6 else 0) for s in range(1, 7)]
    anchors = [(1, 1, "U002", 8, 9, 0.7, "found"), (3, 1, "U001", 1, 5, 0.7, "out"), (4, 1, "U001", 0, 1, 0.6, None), (1, 2, "U003", 20, 22, 0.7, None)]
    recall = [(1, True), (3, True), (4, True), (6, True)]
    decisions = [
        (1, 1, "merge", "P001", 2, 9, 0.9), (1, 1, "merge", "R001", 2, 9, 0.9), (1, 2, "accept", "P002", 10, 14, 0.9), (1, 3, "reject", "R002", None, None, 0.9),
        (3, 1, "accept", "P001", 2, 6, 0.9), (3, 2, "adjust", "P002", 12, 20, 0.9), (4, 1, "guess", "P001", 2, 6, 0.9), (5, 1, "accept", "P001", 2, 6, 0.5), (5, 2, "accept", "P002", 5, 12, 0.9),
    ]
    additions = [(1, 1, k, lo, hi, True, 0.6, None) for k, lo, hi in (("evidence", 30, 31), ("final", 30, 33))]
    make = spark.createDataFrame
    answers = rd.Answers(
        make(ranges, "stream_id long, obj long, lo long, hi long, confidence double, anchor string"), make(discovery, "stream_id long, complete boolean, raw_objects long"),
        make(anchors, "stream_id long, obj long, target string, lo long, hi long, confidence double, anchor string"), make(recall, "stream_id long, complete boolean"),
        make(decisions, "stream_id long, dec long, action string, id string, lo long, hi long, confidence double"),
        make(additions, "stream_id long, add long, kind string, lo long, hi long, final_discovery boolean, confidence double, anchor string"), make([(s, True) for s in range(1, 7)], "stream_id long, complete boolean"),
    )
    results = make([("la la long enough", 1, "Song (Official)", "Singer", "la la long enough", None)], "query string, rank int, title string, artist string, snippet string, hints array<string>")
    return rd.three_round_run(segments, answers, rd.Rules(risk={"soft_min": 30.0}), results=results)


def test_every_outcome(rounds):
    audit = {r.stream_id: r for r in rounds.audit.collect()}
    assert {s: r.status for s, r in audit.items()} == {1: "complete", 2: "discovery_structural_failure", 3: "recall_incomplete", 4: "adjudication_incomplete", 5: "recall_incomplete", 6: "complete"}
    assert audit[2].discovery_error == "discovery_incomplete" and audit[2].final == 0 and audit[2].targets == 0
    assert audit[3].recall_error == "recall_evidence_outside_target" and audit[3].recalled == 0
    assert audit[5].recall_error == "recall_incomplete"
    assert audit[4].adjudication_error == "invalid_action"
    assert (audit[1].discovered, audit[1].targets, audit[1].recalled, audit[1].adjudicated) == (2, 3, 2, 3)
    assert (audit[6].discovered, audit[6].final) == (0, 0)


def test_matches_of_the_run(rounds):
    got = {}
    for r in rounds.matches.orderBy("stream_id", "match_ord").collect():
        got.setdefault(r.stream_id, []).append((r.title, r.lo, r.hi, r.tags))
    assert got[1] == [("未知歌曲：la la", 2, 9, "v3_adjudicated,merge,P001,R001"), ("未知歌曲：P002", 10, 14, "v3_adjudicated,accept,P002"), ("未知歌曲：final_discovery", 30, 33, "v3_adjudicated,final_discovery")]
    assert got[3] == [("未知歌曲：la la", 2, 6, "v3_adjudicated,accept,P001"), ("未知歌曲：P002", 12, 20, "v3_adjudicated,adjust,P002")]
    # provisional candidates, the recalled one after the discovered ones in the list but first by place
    assert [(t, lo, hi, tags) for t, lo, hi, tags in got[4]] == [("未知歌曲：R001", 0, 1, "unadjudicated_recall_anchor,R001"), ("未知歌曲：la la", 2, 6, "precision_discovery,P001"), ("未知歌曲：P002", 10, 39, "precision_discovery,P002")]
    # of two titles that share segments the more confident stays
    assert got[5] == [("未知歌曲：P002", 5, 12, "v3_adjudicated,accept,P002")]
    assert 2 not in got and 6 not in got
    rows = {(r.stream_id, r.match_ord, r.idx) for r in rounds.members.collect()}
    assert {i for s, o, i in rows if (s, o) == (1, 2)} == {30, 31, 32, 33}


def test_searches_of_the_run(rounds):
    said = {(r.stream_id, r.query): r for r in rounds.searches.collect()}
    assert all(not r.accepted and r.reason == "no_items" for r in said.values()) and (1, "la la") in said


def test_boundary_risk_with_both_rules(spark):
    words = ["alpha beta gamma"] * 4 + ["alpha beta delta"] * 4
    rows = [(1, i, i * 10.0 + (50.0 if i >= 4 else 0.0), i * 10.0 + 9.0 + (50.0 if i >= 4 else 0.0), words[i]) for i in range(8)]
    segments = spark.createDataFrame(rows, SEG)
    members = spark.createDataFrame([(1, 0, "a", 0.9, i) for i in range(8)] + [(1, 1, "a", 0.5, i) for i in range(4)] + [(1, 2, "b", 0.5, 77)], MEM)
    by_gap = st.boundary_risk(members, segments, gap_s=40.0, cap_s=35.0)
    assert sorted((r.match_ord, r.idx) for r in by_gap.members.collect()) == [(0, i) for i in range(4)] + [(2, i) for i in range(4, 8)]
    events = {(r.type, r.source_ord, r.before, r.ranges) for r in by_gap.events.collect()}
    assert ("risk_boundary_split", 0, "0-7", "0-3;4-7") in events and ("exact_duplicate", 1, "", "0-3") in events and ("overlong", 0, "", "0-3") in events
    assert by_gap.records.count() == 2
    kept = st.boundary_risk(members, segments, gap_s=40.0, cap_s=0.0, chorus=st.Chorus(120.0, 0.3, 3))
    assert sorted((r.match_ord, r.idx) for r in kept.members.collect()) == [(0, i) for i in range(8)] + [(1, i) for i in range(4)]
    assert kept.events.count() == 0
    apart = st.boundary_risk(members, segments, gap_s=40.0, cap_s=0.0, chorus=st.Chorus(120.0, 0.9, 3))
    assert {r.type for r in apart.events.collect()} == {"risk_boundary_split", "exact_duplicate"}
    whole = st.boundary_risk(members, segments, gap_s=40.0, cap_s=0.0, preserve=True, merge_neighbours=100.0)
    assert {(r.type, r.ranges) for r in whole.events.collect()} >= {("invalid_range", ""), ("merged_same_title", "2>1")}


def test_carried_columns_of_merged_matches(spark):
    segments = spark.createDataFrame(stream(1, 6), SEG)
    members = spark.createDataFrame([(1, 0, "a", 0.5, 0, "x"), (1, 1, "A", 0.9, 1, "y")], MEM + ", tags string")
    out = st.normalised(members, segments, gap_s=40.0, cap_s=0.0, merge_neighbours=40.0, carry=("tags",)).members.collect()
    assert {(r.match_ord, r.title, r.tags) for r in out} == {(0, "A", "y")}


TITLES = {
    "Song (Official Video HD)": "Song", "Song - lyrics Official": "Song", "Song MV HD": "Song", "Song With Pinyin By Someone": "Song", "你好 歌詞 abc": "你好", "你好 The Good Day": "你好", "Ni Hao 你好": "你好",
    "Song The Good Day": "Song The Good Day", "Song | TikTok": "Song", "Song - Shazam": "Song", "Song — Spotify": "Song", "Song - YouTube": "Song", "Song – KKBOX": "Song", "Song | Genius": "Song",
    "Song - AZLyrics.com": "Song", "Song - JustSomeLyrics": "Song", "Song - hymnal.net": "Song", "Song Song Lyrics, Music Videos & Concerts": "Song", "Song Music Videos & Concerts": "Song",
    "Song arranged by Bob": "Song", "Song (book)": "Song", "  A   B  ": "A B", "": "", "Lyrics": "Lyrics",
}


def test_page_titles(spark):
    rows = spark.createDataFrame(list(TITLES.items()) + [(None, None)], "t string, want string")
    assert [r for r in rows.withColumn("got", page_title(F.col("t"))).collect() if r.got != r.want] == []


def test_search_verification(spark):
    segments = spark.createDataFrame(stream(1, 6, texts=["hello dark friend", "come to talk", "again tonight", "vision softly creeping", "left its seeds", "x"]), SEG)
    members = spark.createDataFrame([(1, o, "未知歌曲：a", 0.5, i) for o in range(4) for i in range(5)], MEM)
    head = "stream_id long, match_ord long, title string, artist string, tags string, snippet string, description string"
    matches = spark.createDataFrame([(1, 0, "未知歌曲：a", "", "x", "vision softly creeping", ""), (1, 1, "Known", "me", "", "vision softly creeping", ""), (1, 2, "unknown 2", "", "", "tiny", ""), (1, 3, "未知歌曲：b", "", "", "nothing is like it", "")], head)
    said = "hello dark friend come to talk again tonight vision softly creeping left its seeds"
    results = spark.createDataFrame(
        [("vision softly creeping", 1, "Wrong - YouTube", None, "other words", ["not it"]), ("vision softly creeping", 2, "Right (Lyrics)", " Duo ", "a vision softly planted", ["not it"]), ("vision softly creeping", 3, "Late", None, "vision softly creeping", None),
         (said, 1, "x", None, said, None), (said, 2, "By hint | Genius", "", "unlike", ["come to talk again"]), (said, 4, "Too low", None, said, None)],
        "query string, rank int, title string, artist string, snippet string, hints array<string>",
    )
    named, audit = nm.search_verification(matches, members, segments, results)
    assert {r.match_ord: (r.title, r.artist, r.tags) for r in named.collect()} == {0: ("Right", "Duo", "x,search_verified"), 1: ("Known", "me", ""), 2: ("By hint", "", "search_verified"), 3: ("未知歌曲：b", "", "")}
    told = {r.match_ord: r for r in audit.collect()}
    assert set(told) == {0, 2, 3} and told[0].candidates == 3 and told[2].candidates == 1 and told[3].reason == "no_items"
    assert {r.match_ord for r in nm.search_verification(matches, members, segments, results, most=1)[1].collect()} == {0}
    assert {r.match_ord for r in nm.search_verification(matches, members, segments, results, unknown_only=False)[1].collect()} == {0, 1, 2, 3}


def plain_packed(ranges, span, most=None):
    out, window, begin, units = [], -1, 0, 0
    for lo, hi, n in sorted(ranges):
        if window >= 0 and hi - begin + 1 <= span and (most is None or units + n <= most):
            units += n
        else:
            window, begin, units = window + 1, lo, n
        out.append((lo, hi, window))
    return out


def plain_merged(parts, gap, cap):
    out = []
    for p in sorted(parts, key=lambda p: (p["start_s"], p["match_ord"], p["part"])):
        last = out[-1] if out else None
        if last and ((p["lo"] <= last["hi"] and p["hi"] >= last["lo"]) or (p["start_s"] - last["end_s"] <= gap and p["title"] == last["title"])) and (cap <= 0 or max(last["end_s"], p["end_s"]) - min(last["start_s"], p["start_s"]) <= cap):
            last |= {"end_s": max(last["end_s"], p["end_s"]), "lo": min(last["lo"], p["lo"]), "hi": max(last["hi"], p["hi"]), "confidence": max(last["confidence"], p["confidence"]), "transcript": last["transcript"] + " " + p["transcript"]}
            last["title"] = p["title"] if len(p["title"]) > len(last["title"]) else last["title"]
        else:
            out.append(dict(p))
    return out


def test_folds_against_plain_ones(spark):
    rnd = random.Random(6)
    parts = [dict(stream_id=s, match_ord=o, part=o % 2, start_s=float(a), end_s=float(a + rnd.randint(0, 30)), lo=a // 5, hi=a // 5 + rnd.randint(0, 6), title=rnd.choice(("a", "bb", "ccc")), confidence=rnd.random(), transcript=f"t{o}")
             for s in (1, 2, 3) for o, a in enumerate(rnd.choices(range(300), k=80))]
    df = spark.createDataFrame(parts, "stream_id long, match_ord long, part long, start_s double, end_s double, lo long, hi long, title string, confidence double, transcript string")
    for gap, cap in ((0.0, 0.0), (10.0, 60.0), (40.0, 25.0)):
        got = sorted((r.asDict() for r in clips.merge_adjacent(df, gap, cap).collect()), key=lambda r: (r["stream_id"], r["start_s"], r["match_ord"], r["part"]))
        assert got == [m for s in (1, 2, 3) for m in plain_merged([p for p in parts if p["stream_id"] == s], gap, cap)]
    ranges = [(s, lo, lo + rnd.randint(0, 9), rnd.randint(1, 4)) for s in (1, 2) for lo in rnd.sample(range(500), 60)]
    for span, most in ((20, None), (30, 5), (1, None)):
        got = sorted(tuple(r) for r in iv.packed(spark.createDataFrame(ranges, "stream_id long, lo long, hi long, n long"), span, most).collect())
        assert got == sorted((s, *r) for s in (1, 2) for r in plain_packed([x[1:] for x in ranges if x[0] == s], span, most))


def test_a_million_segments_without_a_silence(spark):
    """One stream, no gap anywhere: the folds see row by row, and what they give is as long as it must be."""
    n = 1_000_000
    rows = spark.range(n).withColumnRenamed("id", "k")
    words = rows.select(F.lit(1).cast("long").alias("stream_id"), F.col("k").alias("word_idx"), (F.col("k") * 0.5).alias("start_s"), (F.col("k") * 0.5 + 0.5).alias("end_s"), F.lit("w").alias("word"))
    seen = st.words_to_segments(words, gap_s=1.0, cap_s=10.0).agg(F.count("*"), F.min(F.length("text")), F.max(F.length("text"))).first()
    assert tuple(seen) == (n // 20, 20, 20)
    parts = rows.select(F.lit(1).cast("long").alias("stream_id"), F.col("k").alias("match_ord"), F.lit(0).cast("long").alias("part"), (F.col("k") * 2.0).alias("start_s"), (F.col("k") * 2.0 + 1.5).alias("end_s"), F.col("k").alias("lo"), F.col("k").alias("hi"), F.lit("same").alias("title"), F.lit(0.5).alias("confidence"), F.lit("x").alias("transcript"))
    seen = clips.merge_adjacent(parts, 1.0, 360.0).agg(F.count("*"), F.max(F.col("end_s") - F.col("start_s"))).first()
    assert seen[1] <= 360.0 and seen[0] == -(-n // 180)
    assert iv.packed(parts.select("stream_id", "lo", "hi"), 50).agg(F.max("window")).first()[0] == n // 50 - 1


def test_a_hot_title(spark):
    """A title of 100,000 matches in one stream: risks, conflicts and containment without pairs of all of them."""
    n = 100_000
    k = F.col("id")
    segments = spark.range(2 * n).select(F.lit(1).cast("long").alias("stream_id"), k.alias("idx"), (k * 5.0).alias("start_s"), (k * 5.0 + 4.0).alias("end_s"), F.lit("t").alias("text"))
    members = spark.range(n).select(F.lit(1).cast("long").alias("stream_id"), k.alias("match_ord"), F.lit("hot").alias("title"), F.lit(0.2).alias("confidence"), F.explode(F.array(k * 2, k * 2 + 1)).alias("idx"))
    far = mt.risks(members, segments, soft_min=1.0, soft_max=20.0, gap=20.0).groupBy().agg(F.count("*"), F.min("overlap"), F.count_if(F.array_contains("reasons", "distant_same_title"))).first()
    assert tuple(far) == (n, 1.0, n)
    edges = mt.conflict_edges(members, mt.heads(members), span=4)
    assert edges.count() == n - 1
    titles = spark.range(n).select(F.concat(F.lit("unknown: "), k).alias("key"))
    assert mt.containing(titles, spark.createDataFrame([("known: 77",), ("",), ("zz",), ("7",)], "key string")).groupBy("inner").count().where("inner <> '' or count = 100000").count() == 3


def test_risk_distances_against_all_pairs(spark):
    rnd = random.Random(8)
    for _ in range(3):
        n = 60
        segments = spark.createDataFrame(stream(1, n, step=30.0), SEG)
        spans = [(o, rnd.choice("ab"), lo, min(n - 1, lo + rnd.randint(0, 5))) for o, lo in enumerate(rnd.choices(range(n), k=25))]
        members = spark.createDataFrame([(1, o, t, 0.9, i) for o, t, lo, hi in spans for i in range(lo, hi + 1)], MEM)
        want = {}
        for o, t, lo, hi in spans:
            stop = min((p for p, u, l2, h2 in spans if u != t and l2 <= hi and h2 >= lo), default=10**9)
            far = [(lo * 30.0 - (h2 * 30.0 + 10.0)) if lo > h2 else (l2 * 30.0 - (hi * 30.0 + 10.0)) for p, u, l2, h2 in spans if u == t and p != o and p < stop and max(lo, l2) > min(hi, h2)]
            want[o] = max((f for f in far if f > 20.0), default=None) is not None
        got = {r.match_ord: "distant_same_title" in r.reasons for r in mt.risks(members, segments).collect()}
        assert got == want
