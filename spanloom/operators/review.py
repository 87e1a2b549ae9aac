"""Review and audit of match clusters, request and response rows, run gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.scalars import canonical_title, expand_ranges, title_key
from spanloom.operators import coverage as cv, intervals as iv, matches as mt, protocol as pr, stages as st
from spanloom.operators.intervals import MATCH
from spanloom.sources.checkpoints import cut


def outside_clusters(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members of matches in no cluster."""
    return members.join(clusters.select(*MATCH), MATCH, "left_anti")


def cluster_ranges(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(stream_id, cluster, lo, hi, candidates): the hull of each cluster."""
    rows = mt.heads(members).join(clusters, MATCH)
    return rows.groupBy("stream_id", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("candidates"))


def inside_targets(ranges: DataFrame, targets: DataFrame) -> DataFrame:
    """Ranges that some target range of their stream holds whole: the farthest end of the targets that begin at or before a range reaches its end."""
    row = F.struct(*ranges.columns)
    both = ranges.select("stream_id", "lo", "hi", F.lit(1).alias("kind"), row.alias("r")).unionByName(targets.select("stream_id", "lo", "hi", F.lit(0).alias("kind")), allowMissingColumns=True)
    reach = F.max(F.when(F.col("kind") == 0, F.col("hi"))).over(Window.partitionBy("stream_id").orderBy("lo", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("reach", reach).where("kind = 1 and hi <= reach").select("r.*").distinct()


def all_audited(clusters: DataFrame, audited: DataFrame) -> DataFrame:
    """Clusters of which every match has been audited before."""
    seen = audited.select(*MATCH).distinct().withColumn("seen", F.lit(True))
    rows = clusters.join(seen, MATCH, "left").groupBy("stream_id", "cluster").agg(F.bool_and(F.col("seen").isNotNull()).alias("all_seen"))
    return rows.where("all_seen").select("stream_id", "cluster")


def sanitise_review(reviewed: DataFrame, old: DataFrame, targets: DataFrame, segments: DataFrame, *, gap_s: float) -> DataFrame:
    """Reviewed matches that touch the old coverage stay whole, others are cropped to the targets; then titles merge."""
    touching = reviewed.join(old.select("stream_id", "idx").distinct(), ["stream_id", "idx"], "left_semi").select(*MATCH).distinct()
    kept = reviewed.join(touching, MATCH, "left_semi")
    rest = cv.crop(reviewed.join(touching, MATCH, "left_anti"), targets)
    return mt.merge_same_title(kept.unionByName(rest), segments, gap_s)


def full_audit(answers: DataFrame, fallback: DataFrame, targets: DataFrame, failed: DataFrame) -> DataFrame:
    """Audit answers inside the targets; streams whose logs failed take the windowed answers in their place."""
    f = failed.select("stream_id").distinct()
    return cv.audit_answers(answers.join(f, "stream_id", "left_anti"), targets).unionByName(cv.audit_answers(fallback.join(f, "stream_id", "left_semi"), targets))


def anchor_recheck(anchors: DataFrame, base: DataFrame, segments: DataFrame, *, least_s: float, most: int, gap_s: float, cap_s: float) -> DataFrame:
    """Anchors (members) with enough evidence, thinned, and grown inside the long uncovered ranges."""
    free = iv.range_seconds(iv.uncovered(segments, base), segments).where(F.col("seconds") >= least_s).select("stream_id", "lo", "hi")
    h = mt.heads(anchors).select("stream_id", F.col("match_ord").alias("obj"), "lo", "hi")
    good = pr.evidence_enough(h, segments).select("stream_id", F.col("obj").alias("match_ord"))
    seeds = pr.thin(anchors.join(good, MATCH, "left_semi"), most)
    return cv.expand_anchors(seeds, free, base, segments, gap_s=gap_s, cap_s=cap_s)


def temporal_gate(logs: DataFrame) -> DataFrame:
    """(stream_id, valid, failures) of logged answers (stream_id, readable, error, finish_reason, parse_valid): valid if one is without error and parsed, and none is unreadable, cut off or unparsed."""
    parsed = F.coalesce("parse_valid", F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(~F.col("readable"), F.lit("invalid_debug")), F.when(F.col("readable") & (F.col("finish_reason") == "length"), F.lit("output_truncated")), F.when(F.col("readable") & ~parsed, F.lit("invalid_result_json"))
    ))
    good = F.col("readable") & (F.coalesce("error", F.lit("")) == "") & parsed
    rows = logs.select("stream_id", kinds.alias("kinds"), good.alias("good")).groupBy("stream_id").agg(F.bool_or("good").alias("good"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))), ",").alias("failures"))
    return rows.select("stream_id", (F.col("good") & (F.col("failures") == "")).alias("valid"), "failures")


def temporal_run(temporal: DataFrame, source: DataFrame, logs: DataFrame, segments: DataFrame, *, gap_s: float, cap_s: float) -> tuple[DataFrame, DataFrame]:
    """(members, audit): temporal matches of valid streams, cut at source boundaries, named after their sources and normalised; other streams keep their source as it is.

    audit has (stream_id, status, failures, input, temporal, refined, output) for
    each stream with source or temporal matches; one without a log falls back.
    What several steps read is kept once on the way (eager actions).
    """
    streams = source.select("stream_id").union(temporal.select("stream_id")).distinct()
    gate = cut(streams.join(temporal_gate(logs), "stream_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False))))
    v = gate.where("valid").select("stream_id")
    own, old = cut(temporal.join(v, "stream_id", "left_semi")), cut(source.join(v, "stream_id", "left_semi"))
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("match_ord", "part")).cast("long")
    parts = mt.split_at_sources(own, old).withColumn("new", place).select(*MATCH, "new", "lo", "hi")
    refined = cut(own.join(parts, MATCH).where(F.col("idx").between(F.col("lo"), F.col("hi"))).select("stream_id", F.col("new").alias("match_ord"), "title", "confidence", "idx"))
    named = mt.restore_titles(refined, old)
    keyed = lambda df, origin: df.select("stream_id", F.lit(origin).alias("origin"), "match_ord", "idx")
    every = keyed(refined, "temporal").union(keyed(old, "source")).join(named.select("stream_id", "origin", "match_ord", "title", "confidence"), ["stream_id", "origin", "match_ord"])
    order = F.dense_rank().over(Window.partitionBy("stream_id").orderBy(F.desc("origin"), "match_ord")) - 1  # restored ones, then sources
    listed = cut(every.select("stream_id", order.cast("long").alias("match_ord"), "title", "confidence", "idx"))
    done, _ = st.normalise(listed, segments, gap_s=gap_s, cap_s=cap_s)
    kept = source.join(gate.where("not valid"), "stream_id", "left_semi").select("stream_id", "match_ord", "title", "confidence", "idx")
    members = done.select("stream_id", "match_ord", "title", "confidence", "idx").union(kept)
    n = lambda df, c: df.groupBy("stream_id").agg(F.count_distinct("match_ord").alias(c))
    audit = gate
    for df, c in ((source, "input"), (own, "temporal"), (refined, "refined"), (members, "output")):
        audit = audit.join(n(df, c), "stream_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("input", "temporal", "refined", "output")]
    return members, audit.select("stream_id", F.when(F.col("valid"), "success").otherwise("fallback_source").alias("status"), F.coalesce("failures", F.lit("")).alias("failures"), *counts)


def required_titles(matches: DataFrame, required: dict[str, bool], aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """(stream_id, title, found, ok) for each stream with matches and each required title: whether it is there, or, where required says True, there once.

    A match (stream_id, match_ord, title) counts if its trimmed title is one of
    the aliases of the required one (itself, where it has none), or its canonical
    form is that title.
    """
    forms = [(t, form, False) for t in required for form in aliases.get(t, (t,))] + [(t, t, True) for t in required]
    known = matches.sparkSession.createDataFrame(forms, "title string, form string, canonical boolean")
    named = matches.select("stream_id", "match_ord", F.trim("title").alias("plain")).where("plain <> ''")
    either = F.array(F.struct(F.col("plain").alias("form"), F.lit(False).alias("canonical")), F.struct(canonical_title(F.col("plain")).alias("form"), F.lit(True).alias("canonical")))
    met = named.select("stream_id", "match_ord", F.explode(either).alias("f")).select("stream_id", "match_ord", "f.*").join(known, ["form", "canonical"])
    found = met.groupBy("stream_id", "title").agg(F.count_distinct("match_ord").alias("found"))
    wanted = F.explode(F.array(*(F.struct(F.lit(t).alias("title"), F.lit(once).alias("once")) for t, once in required.items())))
    every = matches.select("stream_id").distinct().select("stream_id", wanted.alias("w")).select("stream_id", "w.*")
    rows = every.join(found, ["stream_id", "title"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.select("stream_id", "title", "found", F.when(F.col("once"), F.col("found") == 1).otherwise(F.col("found") > 0).alias("ok"))


def run_gates(matches: DataFrame, required: DataFrame, usage: DataFrame, *, least: int, most_calls: int, most_completion: int) -> DataFrame:
    """By stream: required titles found, enough matches, few enough calls and tokens, and the verdict."""
    have = mt.heads(matches).select("stream_id", title_key(F.col("title")).alias("key"))
    need = required.select("stream_id", title_key(F.col("title")).alias("key")).distinct()
    missing = need.join(have.distinct(), ["stream_id", "key"], "left_anti").groupBy("stream_id").agg(F.count("*").alias("missing"))
    n = have.groupBy("stream_id").agg(F.count("*").alias("matches"))
    u = usage.groupBy("stream_id").agg(F.count("*").alias("calls"), F.sum("completion").alias("completion"))
    rows = n.join(missing, "stream_id", "left").join(u, "stream_id", "left").fillna(0)
    ok = (F.col("missing") == 0) & (F.col("matches") >= least) & (F.col("calls") <= most_calls) & (F.col("completion") <= most_completion)
    return rows.withColumn("verdict", F.when(ok, "pass").otherwise("fail"))


def folder_counts(files: DataFrame, matches: DataFrame) -> DataFrame:
    """By folder of (folder, stream_id): recordings, and a text of counts by title."""
    n = files.groupBy("folder").agg(F.count_distinct("stream_id").alias("recordings"))
    by = mt.heads(matches).join(files, "stream_id").groupBy("folder", "title").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("title", "n"))), lambda x: F.concat_ws(":", x["title"], x["n"])), ",")
    return n.join(by.groupBy("folder").agg(text.alias("counts")), "folder", "left")


def response_rows(responses: DataFrame) -> DataFrame:
    """(stream_id, phase, text, finish_reason) of (stream_id, phase, content, reasoning, finish_reason): the content, or else the reasoning."""
    text = F.coalesce(F.nullif(F.trim("content"), F.lit("")), F.nullif(F.trim("reasoning"), F.lit("")), F.lit(""))
    return responses.select("stream_id", "phase", text.alias("text"), F.coalesce("finish_reason", F.lit("stop")).alias("finish_reason"))


def review_requests(members: DataFrame, clusters: DataFrame, segments: DataFrame, context: int) -> DataFrame:
    """A request for each cluster: its range with context, and its candidates as JSON; indices are those of the whole stream."""
    span = iv.expanded(cluster_ranges(members, clusters), segments, context)
    item = F.struct(F.col("match_ord").alias("id"), "title", "lo", "hi")
    c = mt.heads(members).join(clusters, MATCH).groupBy("stream_id", "cluster").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("candidates_json"))
    return span.join(c, ["stream_id", "cluster"]).select("stream_id", "cluster", "lo", "hi", "candidates_json")


def range_items(items: DataFrame) -> DataFrame:
    """Items (stream_id, pos, indices, ranges) with ranges, where there are any, in place of indices; items left empty drop out."""
    return items.withColumn("indices", F.when(F.size("ranges") > 0, expand_ranges(F.col("ranges"))).otherwise(F.col("indices"))).drop("ranges").where(F.size("indices") > 0)


def enabled_types(config: dict) -> list[str]:
    """Content types switched on by a map, a list, or a flag in each type's own settings, in that order of precedence."""
    types = config.get("content_types")
    if isinstance(types, dict):
        return [name for name, on in types.items() if on]
    if isinstance(types, list):
        return list(types)
    return [name for name, own in config.items() if isinstance(own, dict) and own.get("enabled")]


def of_types(matches: DataFrame, config: dict, column: str = "content_type") -> DataFrame:
    """Matches of the enabled types; the filter reaches the scan."""
    return matches.where(F.col(column).isin(enabled_types(config)))

