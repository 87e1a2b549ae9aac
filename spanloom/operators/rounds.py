"""The three rounds of segmentation as one run over many streams, from tables of answers.

Every stream takes its own way: discovery that breaks its rules gives no matches,
recall that breaks them gives no anchors, and adjudication that breaks them leaves
the candidates as provisional matches. All streams go through the same joins;
what has become of each is a column.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import intervals as iv, matches as mt, naming as nm, protocol as pr, stages as st
from spanloom.operators.intervals import MATCH
from spanloom.sources.checkpoints import dealt

CARRY = ("tags", "snippet")


@dataclass(frozen=True)
class Rules:
    """Settings of a run. risk holds those of matches.risks."""

    gap_s: float = 40.0
    cap_s: float = 360.0
    least_s: float = 10.0
    span: int = 500
    most_additions: int = 10
    allow_additions: bool = True
    most_searches: int = 25
    chorus: st.Chorus | None = None
    merge_neighbours: float | None = None
    risk: dict[str, Any] = field(default_factory=dict)


class Answers(NamedTuple):
    """What the annotator said, by round.

    ranges (stream_id, obj, lo, hi, confidence, anchor) and discovery (stream_id,
    complete, raw_objects); anchors (stream_id, obj, target, lo, hi, confidence,
    anchor) and recall (stream_id, complete); decisions (stream_id, dec, action,
    id, lo, hi, confidence), additions as protocol.additions_with_evidence takes
    them, and adjudication (stream_id, complete). A stream without a row in one
    of the status tables has no complete answer.
    """

    ranges: DataFrame
    discovery: DataFrame
    anchors: DataFrame
    recall: DataFrame
    decisions: DataFrame
    additions: DataFrame
    adjudication: DataFrame


class Run(NamedTuple):
    matches: DataFrame  # (stream_id, match_ord, title, artist, tags, confidence, snippet, lo, hi, n)
    members: DataFrame  # the same in long form, (stream_id, match_ord, idx)
    audit: DataFrame  # a row for each stream
    records: DataFrame  # risks after adjudication
    events: DataFrame  # boundary and normalisation events
    searches: DataFrame | None  # look-ups, where results were given


def _by_stream(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("stream_id").agg(F.count("*").alias(name))


def candidates(answers: Answers, segments: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, targets, status) of the first two rounds.

    candidates (stream_id, id, source, anchor, confidence, lo, hi) has a row for
    each range; status has (stream_id, discovery_error, recall_error).
    """
    streams = segments.select("stream_id").distinct()
    found = pr.discovery(answers.ranges, segments)
    said = streams.join(answers.discovery, "stream_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False))).withColumn("raw_objects", F.coalesce("raw_objects", F.lit(0)))
    discovery_error = pr.discovery_reason(said, found).withColumnRenamed("reason", "discovery_error")
    first = found.join(discovery_error.where("discovery_error is null"), "stream_id").select("stream_id", "id", F.lit("precision_discovery").alias("source"), "anchor", "confidence", F.explode("ranges").alias("r"))
    first = dealt(first.select("stream_id", "id", "source", "anchor", "confidence", "r.lo", "r.hi"))

    covered = first.select("stream_id", F.explode(F.sequence("lo", "hi")).alias("idx"))
    going = discovery_error.where("discovery_error is null").select("stream_id")
    targets = dealt(pr.recall_targets(segments.join(going, "stream_id", "left_semi"), covered, rules.least_s))
    bad = pr.recall_reason(answers.anchors, targets)
    whole = streams.join(answers.recall, "stream_id", "left").join(bad, "stream_id", "left")
    recall_error = whole.select("stream_id", F.when(~F.coalesce("complete", F.lit(False)), "recall_incomplete").otherwise(F.col("reason")).alias("recall_error"))
    good = answers.anchors.join(recall_error.where("recall_error is null"), "stream_id", "left_semi")
    text = good.select("stream_id", "obj", F.substring(F.trim(F.coalesce("anchor", F.lit(""))), 1, 200).alias("anchor")).groupBy("stream_id", "obj").agg(F.min("anchor").alias("anchor"))
    second = pr.recall_anchors(good, targets).join(text, ["stream_id", "obj"]).select("stream_id", "id", F.lit("recall_audit").alias("source"), "anchor", "confidence", "lo", "hi")
    return dealt(first.union(second)), targets, discovery_error.join(recall_error, "stream_id")


def _adjudicated(answers: Answers, segments: DataFrame, every: DataFrame, rules: Rules) -> DataFrame:
    """Members of decided streams, with tags and snippet."""
    decisions = answers.decisions
    additions = answers.additions if rules.allow_additions else None
    rows = pr.apply_decisions(decisions, every, additions, segments if additions is not None else None)
    ids = decisions.where("action <> 'reject'").groupBy("stream_id", F.col("dec").alias("match_ord")).agg(F.first("action").alias("action"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))
    tags = F.when(F.col("action").isNull(), "v3_adjudicated,final_discovery").otherwise(F.concat_ws(",", F.lit("v3_adjudicated"), "action", "ids"))
    snippet = F.substring("title", 6, 1000)  # the title after its fixed beginning is the anchor
    return rows.join(ids, MATCH, "left").select("stream_id", "match_ord", "title", "confidence", tags.alias("tags"), snippet.alias("snippet"), "idx")


def _provisional(every: DataFrame) -> DataFrame:
    """Members of candidates as they are, discovered ones first."""
    tag = F.when(F.col("source") == "recall_audit", "unadjudicated_recall_anchor").otherwise(F.col("source"))
    order = F.dense_rank().over(Window.partitionBy("stream_id").orderBy("source", "id"))
    text = F.coalesce(F.nullif(F.trim("anchor"), F.lit("")), F.col("id"))
    rows = every.withColumn("match_ord", order.cast("long"))
    return rows.select(
        "stream_id", "match_ord", F.concat(F.lit("未知歌曲："), text).alias("title"), "confidence", F.concat_ws(",", tag, "id").alias("tags"), F.trim("anchor").alias("snippet"), F.explode(F.sequence("lo", "hi")).alias("idx")
    ).distinct()


def three_round_run(segments: DataFrame, answers: Answers, rules: Rules = Rules(), *, searched: DataFrame | None = None, results: DataFrame | None = None) -> Run:
    """Discovery, recall and adjudication, then boundary risk, final adjudication and, where results are given, search verification.

    searched (title) are titles with evidence from earlier searches; results are
    as in naming.result_items. A stream's status is discovery_structural_failure,
    recall_incomplete, adjudication_incomplete or complete. A stream without
    candidates is complete, with no matches, if its rounds are. What several
    stages read is kept once on the way (eager actions).
    """
    spark = segments.sparkSession
    every, targets, status = candidates(answers, segments, rules)
    live = status.where("discovery_error is null").select("stream_id")
    reason = pr.adjudication_reason(
        answers.decisions.join(live, "stream_id", "left_semi"), every, answers.additions.join(live, "stream_id", "left_semi") if rules.allow_additions else None, segments, None, most_additions=rules.most_additions
    )
    whole = live.join(answers.adjudication, "stream_id", "left").join(reason, "stream_id", "left")
    verdict = dealt(whole.select("stream_id", F.when(~F.coalesce("complete", F.lit(False)), "incomplete").otherwise(F.col("reason")).alias("adjudication_error")))
    decided, open_ = verdict.where("adjudication_error is null").select("stream_id"), verdict.where("adjudication_error is not null").select("stream_id")
    of = lambda df: df.join(decided, "stream_id", "left_semi")
    told = answers._replace(decisions=of(answers.decisions), additions=of(answers.additions))
    members = dealt(_adjudicated(told, segments, every, rules).unionByName(_provisional(every.join(open_, "stream_id", "left_semi"))))

    repaired = st.boundary_risk(members, segments, gap_s=rules.gap_s, cap_s=rules.cap_s, risk=rules.risk, chorus=rules.chorus, merge_neighbours=rules.merge_neighbours, carry=CARRY)
    if searched is None:
        searched = spark.createDataFrame([], "title string")
    final = st.final_adjudication(repaired.members, segments, searched, gap_s=rules.gap_s, span=rules.span, cap_s=rules.cap_s, chorus=rules.chorus, carry=CARRY)
    extra = final.groupBy(*MATCH).agg(F.first("tags").alias("tags"), F.first("snippet").alias("snippet"))
    order = F.row_number().over(Window.partitionBy("stream_id").orderBy("lo", "match_ord")) - 1
    heads = dealt(mt.heads(final).join(extra, MATCH).withColumn("place", order.cast("long")))
    matches = heads.select("stream_id", F.col("place").alias("match_ord"), "title", F.lit("").alias("artist"), "tags", "confidence", "snippet", "lo", "hi", "n")
    rows = final.join(heads.select(*MATCH, "place"), MATCH).select("stream_id", F.col("place").alias("match_ord"), "idx")
    searches = None
    if results is not None:
        named, searches = nm.search_verification(matches.withColumn("description", F.lit("")), rows, segments, results, most=rules.most_searches)
        matches = named.drop("description")

    counts = [
        _by_stream(every.select("stream_id", "id", "source").distinct().where("source = 'precision_discovery'"), "discovered"), _by_stream(targets, "targets"),
        _by_stream(every.select("stream_id", "id", "source").distinct().where("source = 'recall_audit'"), "recalled"), _by_stream(members.select(*MATCH).distinct(), "adjudicated"),
        _by_stream(repaired.records.where("action <> 'accept'"), "review"), _by_stream(heads, "final"),
    ]
    audit = status.join(verdict, "stream_id", "left")
    for c in counts:
        audit = audit.join(c, "stream_id", "left")
    outcome = (
        F.when(F.col("discovery_error").isNotNull(), "discovery_structural_failure").when(F.col("recall_error").isNotNull(), "recall_incomplete")
        .when(F.col("adjudication_error").isNotNull(), "adjudication_incomplete").otherwise("complete")
    )
    numbers = ["discovered", "targets", "recalled", "adjudicated", "review", "final"]
    failed = F.col("discovery_error").isNotNull()
    audit = audit.select("stream_id", outcome.alias("status"), "discovery_error", F.when(failed, None).otherwise(F.col("recall_error")).alias("recall_error"), "adjudication_error", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers))
    return Run(matches, rows, audit, repaired.records, repaired.events, searches)
