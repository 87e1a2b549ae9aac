"""Logged evidence, summaries, required titles and late rows."""

import json

from pyspark.sql import functions as F

from spanloom.operators import logs, review
from spanloom.streaming import operators as so


def test_summaries(spark):
    docs = {
        '{"level_1": []}': "valid", '{"overall": {"a": 1}, "error": null}': "valid", '{"overall": {}, "error": []}': "valid", '{"overall": [], "level_1": {}}': "incomplete", '{"error": "x", "level_1": []}': "error", '{"error": {"a": 1}, "level_1": []}': "error",
        "{}": "empty", "[]": "not_an_object", "3": "not_an_object", "null": "not_an_object", "": "invalid_json", "{": "invalid_json", None: "invalid_json",
    }
    rows = spark.createDataFrame(list(docs.items()), "raw string, want string")
    got = logs.summaries(rows).select("raw", "want", "status", F.col("summary").isNotNull().alias("some")).collect()
    assert [r for r in got if r.status != r.want or r.some != (r.status == "valid")] == []


def test_tool_evidence_never_holds_the_query(spark):
    calls = [
        {"result_summary": {"query": "asked", "results": [{"title": "One"}], "lyrics_hints": ["hint"]}}, {"result_summary": "no object", "result_preview": '{"query": "asked", "results": ["Two"]}'},
        {"result_preview": "{'query': 'asked', 'results': [{'title': 'Three'}]}"}, {"result_preview": "plain four"}, {},
    ]
    rows = spark.createDataFrame([(1, json.dumps({"tool_calls_log": calls})), (2, "broken"), (3, "{}"), (4, None)], "key long, raw string")
    got = {r.call: r.evidence for r in logs.tool_evidence(rows, ["key"]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and not any("asked" in e for e in got.values())
    assert "One" in got[0] and "hint" in got[0] and "Two" in got[1] and "Three" in got[2] and got[3] == "plain four" and got[4] == ""
    matches = spark.createDataFrame([(1, " one ", ""), (1, "Three", "nobody"), (1, "asked", None), (1, "unknown x", "")], "key long, title string, artist string")
    told = {r.title: r.supported for r in logs.supported_titles(matches, logs.tool_evidence(rows, ["key"]), ["key"]).collect()}
    assert told == {" one ": True, "Three": False, "asked": False}


def test_required_titles(spark):
    rows = spark.createDataFrame([(1, 0, " 說夢 "), (1, 1, "ab"), (1, 2, "AB"), (2, 0, "说梦"), (2, 1, "ab"), (2, 1, "ab"), (3, 0, "")], "stream_id long, match_ord long, title string")
    got = {(r.stream_id, r.title): (r.found, r.ok) for r in review.required_titles(rows, {"说梦": False, "ab": True}, {"ab": ("ab", "AB")}).collect()}
    assert got == {(1, "说梦"): (1, True), (1, "ab"): (2, False), (2, "说梦"): (1, True), (2, "ab"): (1, True), (3, "说梦"): (0, False), (3, "ab"): (0, False)}


def test_late_rows_over_restarts(spark, tmp_path):
    taken = []
    route = so.route_late(f"{tmp_path}/late", f"{tmp_path}/seen", "1 hour", lambda b, e: taken.append((e, sorted(r.k for r in b.collect()))))
    batch = lambda *rows: spark.createDataFrame(list(rows), "k long, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    route(batch((1, "2026-01-01 10:00:00"), (2, "2026-01-01 00:00:00")), 0)
    second = batch((3, "2026-01-01 08:00:00"), (4, "2026-01-01 09:30:00"), (5, None))
    route(second, 1)
    # a new process goes on from the tables; the batch that runs twice leaves the same rows
    again = so.route_late(f"{tmp_path}/late", f"{tmp_path}/seen", "1 hour", lambda b, e: taken.append((e, sorted(r.k for r in b.collect()))))
    again(second, 1)
    again(batch((6, "2026-01-01 08:59:59")), 2)
    assert taken == [(0, [1, 2]), (1, [4, 5]), (1, [4, 5]), (2, [])]
    assert sorted((r.epoch, r.k) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/late").collect()) == [(1, 3), (2, 6)]
