"""Queries of the column functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import scalars as sc
from spanloom.plans.inputs import table, transcripts, with_inputs


def q_times(spark, d):
    e = table(spark, d, "events")
    x = F.col("value") * 97
    text = F.concat(F.lit("Duration: 0"), F.col("event_id") % 10, F.lit(":"), F.col("event_id") % 60, F.lit(":"), F.col("event_id") % 59, F.lit(".5 x"))
    clock = F.when(F.col("event_id") % 4 == 0, F.concat_ws(":", F.col("event_id") % 7, F.col("event_id") % 60, F.col("event_id") % 59)).when(F.col("event_id") % 4 == 1, F.concat_ws(":", F.col("event_id") % 60, F.col("event_id") % 59)).when(F.col("event_id") % 4 == 2, F.col("event_id").cast("string")).otherwise("bad")
    rate = F.when(F.col("event_id") % 5 == 0, "0/0").otherwise(F.concat_ws("/", F.col("event_id") % 90, F.col("event_id") % 3))
    return e.select("event_id", sc.timecode(x).alias("timecode"), sc.preview_timecode(x).alias("preview"), sc.log_duration(text).alias("log_s"), sc.parse_time(clock).alias("parsed_s"), sc.fraction(rate).alias("rate"))


def q_confidences(spark, d):
    raw = F.when(F.col("event_id") % 6 == 0, "high").otherwise((F.col("event_id") % 30 / 10 - 1).cast("string"))
    listed = F.array(F.col("event_id") % 5, F.col("event_id") % 3, F.col("event_id") % 5, F.lit(7)).cast("array<string>")
    return table(spark, d, "events").select("event_id", sc.confidence(raw).alias("confidence"), sc.index_list(F.array_append(F.array_append(listed, F.lit("x")), F.lit("true"))).alias("indices"))


def q_ranges(spark, d):
    i = F.col("event_id")
    pair = lambda a, b: F.struct(a.cast("long").alias("lo"), b.cast("long").alias("hi"))
    ranges = F.array(pair(i % 11 - 2, i % 13), pair(i % 7, i % 5), pair(i % 17, i % 17 + 2))
    e = table(spark, d, "events").select("event_id", ranges.alias("r"), (i % 9 + 5).alias("n"))
    clamped = sc.clamp_ranges(F.col("r"), F.col("n"))
    e = e.select("event_id", "r", "n", sc.expand_ranges(F.col("r")).alias("expanded"), clamped.alias("clamped"))
    e = e.select("event_id", "expanded", "clamped", sc.range_indices(F.col("clamped")).alias("indices"), sc.valid_indices(F.col("expanded"), F.col("n")).alias("valid"))
    return e.select("event_id", "expanded", F.transform("clamped", lambda r: F.array(r["lo"], r["hi"])).alias("clamped"), "indices", "valid", F.transform(sc.index_runs(F.col("indices")), lambda r: F.array(r["lo"], r["hi"])).alias("runs"))


def _titles(spark, d):
    t = F.expr("case event_id % 8 when 0 then '' when 1 then 'Unknown song' when 2 then '未知歌曲：a' when 3 then ' 聊天 ' when 4 then 'a�b' else event_type end")
    return table(spark, d, "events").select("event_id", t.alias("title"))


def q_titles(spark, d):
    t = F.col("title")
    return _titles(spark, d).select("event_id", sc.title_key(t).alias("key"), sc.unknown_title(t).alias("unknown"), sc.unknown_prefix(t).alias("prefixed"), sc.named_title(t).alias("named"), sc.invalid_audit_title(t).alias("invalid"), sc.garbled(t).alias("garbled"))


def q_severity(spark, d):
    """Labelled events as described ones; events of no severity or of scenario C are dropped."""
    x = table(spark, d, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("severity"), F.expr("case doc_id % 3 when 0 then 'A' when 1 then 'B' else 'C' end").alias("scenario"))
    x = x.where("scenario <> 'C' and severity <> 0").withColumn("text", sc.described(F.col("severity"), F.col("scenario"), F.concat(F.lit(" event,  number "), F.col("doc_id"))))
    parts = sc.described_parts(F.col("text"))
    return x.select("doc_id", "text", parts["severity"].alias("severity"), parts["scenario"].alias("scenario"), parts["description"].alias("description"), sc.short_title(F.lit(" "), parts["description"]).alias("short"))


def q_text_tokens(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    tok = lambda c: sc.text_tokens(F.col(c))
    return b.join(other, "item_id").select("item_id", sc.language(F.col("text")).alias("language"), F.size(tok("text")).cast("long").alias("n_tokens"), sc.overlap_coefficient(tok("text"), tok("other")).alias("likeness"), sc.lyric_query(F.col("text"), F.lit("x")).alias("query"))


def q_web_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(sc.strip_tags(F.col("html"))).alias("plain_md5"), sc.lyric_of(F.concat(F.lit('say "'), F.col("url"), F.lit('" x'))).alias("lyric"))


def q_lines(spark, d):
    """Requests: twenty lines of a transcript each."""
    line = sc.transcript_line(F.col("idx"), F.col("start_s"), F.col("end_s"), F.col("text"))
    rows = transcripts(spark, d).withColumn("batch", F.floor(F.col("idx") / 3))
    return rows.groupBy("stream_id", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("request"), F.sum(F.length(line)).alias("chars")).withColumn("tokens", sc.tokens_of(F.col("chars")))


def q_log_phases(spark, d):
    path = F.expr("concat(case event_id % 6 when 0 then 'v3/discovery/' when 1 then 'review\\\\before_missed_recheck/' when 2 then 'overlong_recheck/' when 3 then 'missed_recheck/' when 4 then 'temporal_adjudication/' else 'x/' end, event_id, '.json')")
    return table(spark, d, "events").select("event_id", sc.log_phase(path).alias("phase"))


LOGS = (
    "Error: Invalid NAL unit size", "non-monotonic DTS in segment(s) 3, 5 and", "Concat output duration is too short: 12.5s", "Concat output video stream duration is too short: 7s",
    "AAC decode error", "nvenc device unavailable", "moov atom not found; segment(s) 1,2,9", "all good",
)


def q_tool_logs(spark, d):
    text = F.element_at(F.array(*map(F.lit, LOGS)), (F.col("doc_id") % len(LOGS) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws("\n", "text", text).alias("t"))
    summary = F.regexp_replace(F.array_join(sc.log_problems(F.col("t")), ", "), "^$", "unknown/other")
    return rows.select("doc_id", summary.alias("summary"), sc.log_segments(F.col("t")).alias("segments"), sc.failed_duration(F.col("t")).alias("failed_s"))


def q_log_merge(spark, d):
    """Diagnosis of each folder over its attempts: every problem and segment named, and the first telling summary."""
    rows = q_tool_logs(spark, d).withColumn("folder", F.floor(F.col("doc_id") / 3))
    return rows.groupBy("folder").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("segments")))).alias("segments"), F.min(F.when(F.col("summary") != "unknown/other", F.struct("doc_id", "summary")))["summary"].alias("summary"), F.max(F.when(F.col("failed_s").isNotNull(), F.struct("doc_id", "failed_s")))["failed_s"].alias("failed_s"))


def q_dates(spark, d):
    path = F.concat(F.lit("/rec/a_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 3 == 0, "x/261399//250603_").otherwise("/live_"), F.lit("cut.mp4"))
    short = F.regexp_replace(path, "[0-9]{4}-[0-9]{2}-[0-9]{2}", "1")
    return table(spark, d, "orders").select("o_orderkey", sc.date_in(path).alias("date"), sc.date_in(short).alias("short_date"), sc.valid_date(F.lpad((F.col("o_orderkey") % 999999).cast("string"), 6, "0")).alias("valid"))


def q_stems(spark, d):
    s = table(spark, d, "supplier")
    title = F.concat(F.lit(" a: b?"), F.col("s_suppkey") % 7, F.lit("  c."))
    artist = F.when(F.col("s_suppkey") % 2 == 0, F.lit("")).otherwise(F.lit("art/ist"))
    stem = sc.clip_stem(F.col("s_name"), title, artist, F.lit("260603"))
    parts = sc.stem_parts(stem)
    return s.select("s_suppkey", stem.alias("stem"), sc.plain_stem(F.col("s_suppkey"), F.lit("t"), artist).alias("plain"), parts["title"].alias("title"), parts["artist"].alias("artist"))


def q_fingerprints(spark, d):
    """Hash of each stream's lines: streams whose hash is known need no new work."""
    rows = transcripts(spark, d)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: F.concat_ws("|", x["idx"], x["text"])), "\n")
    return rows.groupBy("stream_id").agg(F.sha2(text, 256).alias("fingerprint"))


def q_changed(spark, d):
    """Streams whose fingerprint is not the one of their state row."""
    now = q_fingerprints(spark, d)
    state = now.where("stream_id % 3 <> 0").withColumn("fingerprint", F.when(F.col("stream_id") % 5 == 0, "old").otherwise(F.col("fingerprint")))
    return now.join(state, ["stream_id", "fingerprint"], "left_anti")


QUERIES = {
    "f1_f5_times": q_times, "f6_f7_confidences": q_confidences, "f8_f12_ranges": q_ranges, "f13_f15_f32_titles": q_titles, "f16_f17_p3_severity": q_severity, "f18_f24_text_tokens": q_text_tokens,
    "f20_f21_web_text": q_web_text, "f40_m6_w10_requests": q_lines, "f35_log_phases": q_log_phases, "f38_f39_tool_logs": q_tool_logs, "a18_j16_log_merge": q_log_merge, "f27_f28_dates": q_dates,
    "f29_f31_stems": q_stems, "f34_fingerprints": q_fingerprints, "m10_changed_streams": q_changed,
}

_CLOCK = "printf('%02d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60)"
_LANG = "CASE WHEN len(regexp_extract_all({0}, '[぀-ヿ]')) > 2 THEN 'ja' WHEN len(regexp_extract_all({0}, '[一-鿿]')) > length({0}) * 0.2 THEN 'zh' ELSE 'en' END"
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(trim({0})), '\\s+'), lambda w: regexp_matches(w, '^\\pL+$')))"
_LOGS = "[" + ", ".join(f"'{x}'" for x in LOGS) + "]"
_TOOL = f"""logs AS (SELECT doc_id, coalesce(text || chr(10), '') || ({_LOGS})[doc_id % {len(LOGS)} + 1] AS t FROM documents),
found AS (SELECT doc_id, t, list_filter([CASE WHEN regexp_matches(t, '(?i)Invalid NAL|missing picture|decode_slice_header|h264_mp4toannexb.*(fail|error)|hevc_mp4toannexb.*(fail|error)|Error applying bitstream filters|non-existing PPS|bytestream overread|error while decoding MB|\\bno frame\\b|corrupt decoded frame') THEN 'bitstream_corruption' END,
CASE WHEN regexp_matches(lower(t), 'non.?monotonic|invalid dts|negative ts|timestamp|pts.*(invalid|discontinu)') THEN 'timestamp_discontinuity' END,
CASE WHEN regexp_matches(lower(t), 'concat output (video stream )?duration is too (short|long)') THEN 'duration_truncated' END,
CASE WHEN regexp_matches(lower(t), 'audio.*(not decodable|fail|error|invalid|corrupt)|aac.*(decode|error|invalid|corrupt)') THEN 'audio_decode_fail' END,
CASE WHEN regexp_matches(lower(t), '(unknown encoder|encoder not found|device.*not found|nvenc|qsv|amf).*(fail|error|unavailable|not)') THEN 'hw_unavailable' END,
CASE WHEN regexp_matches(lower(t), 'error during demuxing|error opening input|moov atom not found|partial file|invalid data found when processing input|demux') THEN 'demux_error' END], lambda x: x IS NOT NULL) AS p,
list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(t, '(?i)segment\\(s\\)\\s*([0-9,\\s]+)', 1), lambda x: regexp_extract_all(x, '[0-9]+'))), lambda n: greatest(0, n::BIGINT - 1)))) AS segments,
coalesce(try_cast(regexp_extract(t, '(?i)Concat output video stream duration is too short:\\s*([0-9.]+)s', 1) AS DOUBLE), try_cast(regexp_extract(t, '(?i)Concat output duration is too short:\\s*([0-9.]+)s', 1) AS DOUBLE)) AS failed_s FROM logs),
tool AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN array_to_string(p, ', ') ELSE 'unknown/other' END AS summary, segments, failed_s FROM found)"""
_LONG_DATE = "list_transform(regexp_extract_all({0}, '(?:^|[^0-9])([0-9]{{4}}[-_][0-9]{{2}}[-_][0-9]{{2}})(?:[^0-9]|$)', 1), lambda x: substr(regexp_replace(x, '[-_]', '', 'g'), 3, 6))"
_SHORT_DATE = "regexp_extract_all({0}, '(?:^|[^0-9])([0-9]{{6}})(?:[^0-9]|$)', 1)"
_VALID = "regexp_matches({0}, '^[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$')"


def _date_sql(text: str) -> str:
    return f"list_filter(list_concat({_LONG_DATE.format(text)}, {_SHORT_DATE.format(text)}), lambda x: {_VALID.format('x')})[1]"


_PATH = "'/rec/a_' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN 'x/261399//250603_' ELSE '/live_' END || 'cut.mp4'"
_PRINTS = "prints AS (SELECT stream_id, sha256(string_agg(idx || '|' || text, chr(10) ORDER BY idx)) AS fingerprint FROM transcripts GROUP BY ALL)"

SQL = {
    "f1_f5_times": f"""WITH x AS (SELECT event_id, value * 97 AS v, '0' || event_id % 10 AS h, event_id % 60 AS m, event_id % 59 AS s FROM events),
y AS (SELECT event_id, v, greatest(0, round_even(v, 0)::BIGINT) AS t, floor(v)::BIGINT AS u, h::DOUBLE * 3600 + m * 60 + (s || '.5')::DOUBLE AS log_s, m, s FROM x)
SELECT event_id, {_CLOCK} AS timecode, {_CLOCK.replace('t ', 'u ')} AS preview, log_s,
CASE event_id % 4 WHEN 0 THEN event_id % 7 * 3600 + event_id % 60 * 60 + event_id % 59 WHEN 1 THEN event_id % 60 * 60 + event_id % 59 WHEN 2 THEN event_id END::DOUBLE AS parsed_s,
CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN (event_id % 90)::DOUBLE / (event_id % 3) END AS rate FROM y""",
    "f6_f7_confidences": "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0.5::DOUBLE ELSE least(1, greatest(0, event_id % 30 / 10 - 1)) END AS confidence, CASE WHEN event_id % 5 = event_id % 3 THEN [event_id % 5, 7] ELSE [event_id % 5, event_id % 3, 7] END AS indices FROM events",
    "f8_f12_ranges": """WITH x AS (SELECT event_id, event_id % 9 + 5 AS n, [[event_id % 11 - 2, event_id % 13], [event_id % 7, event_id % 5], [event_id % 17, event_id % 17 + 2]] AS r FROM events),
long AS (SELECT event_id, n, k, unnest(range(r[k][1], r[k][2] + 1)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM x) WHERE r[k][1] >= 0 AND r[k][1] <= r[k][2]),
ex AS (SELECT event_id, list(i ORDER BY k0, i) AS expanded, list(i ORDER BY i) FILTER (i < n) AS valid FROM (SELECT event_id, i, any_value(n) AS n, min(k) AS k0 FROM long GROUP BY event_id, i) GROUP BY event_id),
cl AS (SELECT event_id, n, list_sort(list_filter(list_transform(r, lambda p: [greatest(p[1], 0), least(p[2], n - 1)]), lambda p: p[1] <= p[2])) AS clamped FROM x),
ix AS (SELECT event_id, unnest(range(p[1], p[2] + 1)) AS i FROM (SELECT event_id, unnest(clamped) AS p FROM cl)),
il AS (SELECT event_id, list_sort(list_distinct(list(i))) AS indices FROM ix GROUP BY ALL),
rn AS (SELECT event_id, min(i) AS lo, max(i) AS hi FROM (SELECT event_id, i, i - dense_rank() OVER (PARTITION BY event_id ORDER BY i) AS g FROM ix) GROUP BY event_id, g),
rl AS (SELECT event_id, list([lo, hi] ORDER BY lo) AS runs FROM rn GROUP BY ALL)
SELECT event_id, coalesce(expanded, []) AS expanded, clamped, coalesce(indices, []) AS indices, coalesce(valid, []) AS valid, coalesce(runs, []) AS runs FROM cl LEFT JOIN ex USING (event_id) LEFT JOIN il USING (event_id) LEFT JOIN rl USING (event_id)""",
    "f13_f15_f32_titles": """WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'Unknown song' WHEN 2 THEN '未知歌曲：a' WHEN 3 THEN ' 聊天 ' WHEN 4 THEN 'a' || chr(65533) || 'b' ELSE event_type END AS title FROM events),
k AS (SELECT event_id, title, lower(trim(title)) AS key FROM t)
SELECT event_id, key, key = '' OR key LIKE '未知歌曲%' OR key LIKE 'unknown%' AS unknown, key LIKE '未知歌曲%' OR key LIKE 'unknown%' AS prefixed, trim(title) <> '' AND trim(title) NOT LIKE '未知歌曲%' AS named, key IN ('', 'unknown', '未知', '未知歌曲', '未知歌曲：代表歌词', '未知歌曲:代表歌词', '对话', '对话片段', '聊天', '聊天片段', '非歌曲', '无歌曲') AS invalid, contains(title, chr(65533)) AS garbled FROM k""",
    "f16_f17_p3_severity": """WITH x AS (SELECT doc_id, (quality + 2 * toxic)::BIGINT AS severity, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS scenario FROM labels)
SELECT doc_id, '[严重程度:' || severity || '/5][场景:' || scenario || ']  event,  number ' || doc_id AS text, severity, scenario, 'event,  number ' || doc_id AS description, CASE WHEN length('event, number ' || doc_id) > 19 THEN substr('event, number ' || doc_id, 1, 19) ELSE 'event, number ' || doc_id END AS short FROM x WHERE scenario <> 'C' AND severity <> 0""",
    "f18_f24_text_tokens": f"""WITH b AS (SELECT a.item_id, a.text, o.text AS other FROM benchmark a JOIN benchmark o ON o.item_id = a.item_id + 1), t AS (SELECT *, {_TOK.format('text')} AS x, {_TOK.format('other')} AS y FROM b)
SELECT item_id, {_LANG.format('text')} AS language, len(x) AS n_tokens, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END AS likeness, 'x ' || text || ' lyrics' AS query FROM t""",
    "f20_f21_web_text": "SELECT page_id, md5(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS plain_md5, url AS lyric FROM pages",
    "f40_m6_w10_requests": with_inputs("transcripts", more="lines AS (SELECT stream_id, idx // 3 AS batch, idx, printf('[%d] (%.1f-%.1f) %s', idx, start_s, end_s, text) AS l FROM transcripts), reqs AS (SELECT stream_id, batch, string_agg(l, chr(10) ORDER BY idx) AS request, sum(length(l))::BIGINT AS chars FROM lines GROUP BY ALL)", body="SELECT *, CASE WHEN chars <= 0 THEN 0 ELSE greatest(1, floor(chars * 0.62::DOUBLE)::BIGINT) END AS tokens FROM reqs"),
    "f35_log_phases": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'v3_discovery' WHEN 1 THEN 'review_before' WHEN 2 THEN 'overlong' WHEN 3 THEN 'missed_recheck' WHEN 4 THEN 'temporal_adjudication' ELSE 'main' END AS phase FROM events",
    "f38_f39_tool_logs": f"WITH {_TOOL} SELECT * FROM tool",
    "a18_j16_log_merge": f"WITH {_TOOL} SELECT doc_id // 3 AS folder, list_sort(list_distinct(flatten(list(segments)))) AS segments, arg_min(summary, doc_id) FILTER (summary <> 'unknown/other') AS summary, arg_max(failed_s, doc_id) FILTER (failed_s IS NOT NULL) AS failed_s FROM tool GROUP BY ALL",
    "f27_f28_dates": f"WITH p AS (SELECT o_orderkey, {_PATH} AS path FROM orders), q AS (SELECT *, regexp_replace(path, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '1', 'g') AS short FROM p) SELECT o_orderkey, {_date_sql('path')} AS date, {_date_sql('short')} AS short_date, {_VALID.format(chr(108) + 'pad((o_orderkey % 999999)::VARCHAR, 6, ' + chr(39) + '0' + chr(39) + ')')} AS valid FROM q",
    "f29_f31_stems": "WITH x AS (SELECT s_suppkey, s_name, 'a_ b_' || s_suppkey % 7 || ' c' AS t, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '-art_ist' END AS a FROM supplier) SELECT s_suppkey, '【' || s_name || '】' || t || a || '-260603' AS stem, printf('%03d', s_suppkey) || '-t' || CASE WHEN a = '' THEN '' ELSE '-art/ist' END AS plain, t AS title, ltrim(a, '-') AS artist FROM x",
    "f34_fingerprints": with_inputs("transcripts", more=_PRINTS, body="SELECT * FROM prints"),
    "m10_changed_streams": with_inputs("transcripts", more=_PRINTS, body="SELECT * FROM prints WHERE stream_id % 3 = 0 OR stream_id % 5 = 0"),
}
