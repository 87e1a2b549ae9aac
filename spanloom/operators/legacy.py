"""The older run over a first annotation: review, over-long recheck, missed recheck, review again.

Each stage asks a caller's annotate function (see annotate.py) about all streams
at once and keeps its result, dealt by stream, before the next one begins (eager
actions).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.scalars import UNNAMED, title_key
from spanloom.operators import annotate as an, coverage as cv, intervals as iv, matches as mt, responses as rs, review as rv, stages as st
from spanloom.operators.intervals import MATCH
from spanloom.sources.checkpoints import dealt

MEMBER = ["stream_id", "match_ord", "title", "confidence", "idx"]


@dataclass(frozen=True)
class Rules:
    """gap_s and cap_s as in clips; span bounds clusters and reviewed windows (in segments), nearby the distance of conflicting titles; chunk, pack and least_s shape the missed recheck; merge_s, if given, merges titles after a review."""

    gap_s: float = 40.0
    cap_s: float = 360.0
    span: int = 500
    nearby: int = 0
    context: int = 10
    chunk: int = 200
    pack: int = 500
    least_s: float = 75.0
    merge_s: float | None = None
    kind: an.ContentType = field(default_factory=lambda: an.ContentType("song"))


class Run(NamedTuple):
    members: DataFrame
    audit: DataFrame  # (stream_id, stage, asked, taken, before, after)


def _named(title: str) -> Column:
    return ~F.startswith(F.trim(title), F.lit(UNNAMED))


def _listed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Members (with the columns of order) as one list a stream, numbered in that order."""
    place = F.dense_rank().over(Window.partitionBy("stream_id").orderBy(*order)) - 1
    return rows.withColumn("match_ord", place.cast("long")).select(*MEMBER)


def _audit(stage: str, before: DataFrame, after: DataFrame, asked: DataFrame, taken: DataFrame) -> DataFrame:
    n = lambda df, c: df.groupBy("stream_id").agg(F.count_distinct("match_ord").alias(c))
    k = lambda df, c: df.groupBy("stream_id").agg(F.count("*").alias(c))
    rows = n(before, "before").join(n(after, "after"), "stream_id", "full").join(k(asked, "asked"), "stream_id", "full").join(k(taken, "taken"), "stream_id", "full")
    return rows.select("stream_id", F.lit(stage).alias("stage"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("asked", "taken", "before", "after")))


def review(members: DataFrame, segments: DataFrame, annotate: an.Annotate, searched: DataFrame, rules: Rules, phase: str) -> Run:
    """Asks about each cluster of conflicting or suspicious matches, and takes the answer if it can be read, holds no overlap of different titles and does not lose every name; else the cluster's best matches stay.

    A cluster wider than span is not asked about. Matches of an answer that has
    fewer than its cluster stay whole across gaps. What conflicts are left are
    settled by evidence.
    """
    n = st.normalised(members, segments, gap_s=rules.gap_s, cap_s=rules.cap_s, keep=dealt)
    rows, suspicious = dealt(n.members), dealt(n.flags.select(*MATCH).distinct())
    clusters = dealt(mt.clusters(mt.conflict_edges(rows, suspicious, span=rules.span, nearby=rules.nearby), suspicious))
    ranges = rv.cluster_ranges(rows, clusters).where(F.col("hi") - F.col("lo") + 1 <= rules.span)
    item = F.to_json(F.sort_array(F.collect_list(F.struct(F.col("match_ord").alias("id"), "title", "lo", "hi"))))
    notes = mt.heads(rows).join(clusters, MATCH).groupBy("stream_id", "cluster").agg(item.alias("note"))
    wide = iv.expanded(ranges, segments, rules.context).join(notes, ["stream_id", "cluster"]).withColumnRenamed("cluster", "request")
    said = an.ask(an.range_requests(wide, segments, rules.kind, phase), annotate)

    answers = rules.kind.parse(said).join(said.select("stream_id", "request", "lo", "hi"), ["stream_id", "request"]).where(F.col("idx").between(F.col("lo"), F.col("hi")))
    answers = dealt(answers.select("stream_id", F.col("request").alias("cluster"), "match_ord", "title", "confidence", "idx"))
    key = ["stream_id", "cluster"]
    given = answers.groupBy(*key).agg(F.count_distinct("match_ord").alias("given"), F.bool_or(_named("title")).alias("names"))
    own = mt.heads(rows).join(clusters, MATCH).groupBy(*key).agg(F.count("*").alias("own"), F.bool_or(_named("title")).alias("named"))
    clash = answers.groupBy(*key, "idx").agg(F.count_distinct(title_key(F.col("title"))).alias("titles")).where("titles > 1").select(*key).distinct().withColumn("clash", F.lit(True))
    read = rs.parsed(said).select("stream_id", F.col("request").alias("cluster"), (F.col("status") == "ok").alias("read"))
    loses = F.col("named") & ~F.coalesce("names", F.lit(False))
    fine = F.coalesce("read", F.lit(False)) & F.col("clash").isNull() & ~loses
    verdict = own.join(read, key, "left").join(given, key, "left").join(clash, key, "left").select(*key, fine.alias("taken"), F.coalesce(F.col("given") < F.col("own"), F.lit(False)).alias("whole"))
    verdict = dealt(verdict)

    good = answers.join(verdict.where("taken"), key)
    split = iv.split_at_gaps(good, segments, rules.gap_s).withColumn("part", F.when(F.col("whole"), 0).otherwise(F.col("part")))
    lost = clusters.join(verdict.where("not taken").select(*key), key, "left_semi")
    best = mt.select_best(rows, lost, segments, searched, rules.cap_s).where("action = 'keep'")
    first = mt.heads(rows).select(*MATCH, "lo")
    kept = rows.join(best.select(*MATCH, "cluster"), MATCH).join(first, MATCH)
    zero = F.lit(0).cast("long")
    columns = [*MEMBER, "kind", "cluster", "a", "b"]
    every = (
        rv.outside_clusters(rows, clusters).select(*MEMBER, F.lit(0).alias("kind"), zero.alias("cluster"), F.col("match_ord").alias("a"), zero.alias("b"))
        .union(kept.select(*MEMBER, F.lit(1), "cluster", F.col("lo"), F.col("match_ord"))).union(split.select(*MEMBER, F.lit(1), "cluster", F.col("match_ord"), F.col("part").cast("long")))
    ).toDF(*columns)
    listed = _listed(every, ["kind", "cluster", "a", "b"])
    final = dealt(st.normalised(listed, segments, gap_s=rules.gap_s, cap_s=rules.cap_s, keep=dealt).members)
    out = dealt(st.residual_pass(final, segments, searched, span=rules.span, cap_s=rules.cap_s, merge_s=rules.merge_s))
    return Run(out, _audit(phase, members, out, said, verdict.where("taken")))


def overlong_recheck(members: DataFrame, segments: DataFrame, annotate: an.Annotate, rules: Rules) -> Run:
    """Asks about every part longer than the cap, and takes the answers inside it if there are any and none is over-long; the other parts of such a match become matches of their own."""
    parts = iv.split_at_gaps(members, segments, rules.gap_s).select(*MEMBER, "part")
    long = cv.overlong(members, segments, rules.gap_s, rules.cap_s)
    number = (F.row_number().over(Window.partitionBy("stream_id").orderBy("match_ord", "part")) - 1).cast("long")
    asked = dealt(long.withColumn("request", number))
    wide = iv.expanded(asked, segments, rules.context).select("stream_id", "request", "lo", "hi", F.lit(None).cast("string").alias("note"))
    said = an.ask(an.range_requests(wide, segments, rules.kind, "overlong"), annotate)
    answers = dealt(rules.kind.parse(said).join(asked.select("stream_id", "request", "lo", "hi"), ["stream_id", "request"]).where(F.col("idx").between(F.col("lo"), F.col("hi"))).select(*MEMBER, "request"))
    still = cv.overlong(answers, segments, rules.gap_s, rules.cap_s).select(*MATCH).distinct().join(answers.select(*MATCH, "request").distinct(), MATCH).select("stream_id", "request").distinct()
    taken = dealt(answers.select("stream_id", "request").distinct().join(still, ["stream_id", "request"], "left_anti"))

    zero = F.lit(0).cast("long")
    affected = asked.select(*MATCH).distinct()
    replaced = asked.join(taken, ["stream_id", "request"], "left_semi")
    new = answers.withColumnRenamed("match_ord", "b").join(replaced.select("stream_id", "request", "match_ord", "part"), ["stream_id", "request"])
    old = parts.join(affected, MATCH, "left_semi").join(replaced.select(*MATCH, "part"), [*MATCH, "part"], "left_anti")
    every = (
        members.join(affected, MATCH, "left_anti").select(*MEMBER, zero.alias("part"), zero.alias("b")).union(old.select(*MEMBER, F.col("part").cast("long"), zero)).union(new.select(*MEMBER, F.col("part").cast("long"), "b"))
    ).withColumn("a", F.col("match_ord"))
    out = dealt(_listed(every, ["a", "part", "b"]))
    return Run(out, _audit("overlong", members, out, said, taken))


def missed_recheck(members: DataFrame, segments: DataFrame, annotate: an.Annotate, rules: Rules) -> Run:
    """Asks about the uncovered ranges that are long enough, packed into windows; answers are cropped to those ranges, and normalised and merged together with what there was."""
    targets = iv.range_seconds(iv.chunked(iv.uncovered(segments, members), rules.chunk), segments).where(F.col("seconds") >= rules.least_s)
    targets = dealt(targets.select("stream_id", "lo", "hi"))
    windows = iv.packed(targets, rules.pack).groupBy("stream_id", F.col("window").alias("request")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    wide = iv.expanded(windows, segments, rules.context).withColumn("note", F.lit(None).cast("string"))
    said = an.ask(an.range_requests(wide, segments, rules.kind, "missed"), annotate)
    shown = rules.kind.parse(said).join(said.select("stream_id", "request", "lo", "hi"), ["stream_id", "request"]).where(F.col("idx").between(F.col("lo"), F.col("hi"))).select(*MEMBER, "request")
    extra = dealt(cv.crop(shown, targets))
    out = dealt(st.finish_recheck(members, extra.select(*MEMBER), segments, gap_s=rules.gap_s, cap_s=rules.cap_s, keep=dealt).select(*MEMBER))
    return Run(out, _audit("missed", members, out, said, extra.select("stream_id", "request").distinct()))


def legacy_run(members: DataFrame, segments: DataFrame, annotate: an.Annotate, rules: Rules = Rules(), *, searched: DataFrame | None = None) -> Run:
    """All four stages. audit has a row for each stream and stage that had matches or requests: requests, answers taken, matches before and after."""
    if searched is None:
        searched = segments.sparkSession.createDataFrame([], "title string")
    first = review(members, segments, annotate, searched, rules, "review_before")
    long = overlong_recheck(first.members, segments, annotate, rules)
    missed = missed_recheck(long.members, segments, annotate, rules)
    last = review(missed.members, segments, annotate, searched, rules, "review_after")
    return Run(last.members, first.audit.union(long.audit).union(missed.audit).union(last.audit))
