"""Estimated cost of every stage of the older run, and the joint choice of review scope and missed-recheck strategy.

A request costs the tokens of the lines it shows and of its instructions; with
the transcript first in a request, a whole transcript is cached input. Characters
of a range are differences of running sums, so no range is expanded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.scalars import price, tokens_of, transcript_line
from spanloom.operators import coverage as cv, intervals as iv, review as rv
from spanloom.operators.usage import COMPLETION

SCOPES, STRATEGIES = ("local", "full"), ("windowed", "full_transcript")


@dataclass(frozen=True)
class Rules:
    """Settings: lines of a main request, characters of a request's instructions, context and bounds in segments, penalty of a full audit that may have to fall back to windows, and the margin within which the cautious pair stays."""

    lines: int = 20
    template_chars: int = 400
    context: int = 10
    most_window: int = 500
    pack: int = 500
    gap_s: float = 40.0
    cap_s: float = 360.0
    rounds: int = 1
    most_segments: int = 3500
    penalty: float = 1.0
    margin: float = 0.1


def _running(segments: DataFrame) -> DataFrame:
    """(stream_id, idx, chars): characters of all lines up to each segment, each with its line feed."""
    line = F.length(transcript_line(F.col("idx"), F.col("start_s"), F.col("end_s"), F.col("text"))) + 1
    return segments.select("stream_id", "idx", F.sum(line).over(Window.partitionBy("stream_id").orderBy("idx")).alias("chars"))


def _shown(ranges: DataFrame, running: DataFrame) -> DataFrame:
    """ranges with chars, the characters of their lines."""
    to = running.select("stream_id", F.col("idx").alias("hi"), F.col("chars").alias("to_chars"))
    before = running.select("stream_id", (F.col("idx") + 1).alias("lo"), F.col("chars").alias("before_chars"))
    return ranges.join(to, ["stream_id", "hi"]).join(before, ["stream_id", "lo"], "left").withColumn("chars", F.col("to_chars") - F.coalesce("before_chars", F.lit(0))).drop("to_chars", "before_chars")


def _calls(rows: DataFrame, rules: Rules, kind: str, name: str, *, whole: Column | None = None) -> DataFrame:
    """(stream_id, stage cost) of requests with chars; with ``whole`` the transcript of so many characters is cached input and chars is none."""
    template = tokens_of(F.lit(rules.template_chars))
    hit = tokens_of(whole) if whole is not None else F.lit(0)
    miss = template if whole is not None else tokens_of(F.col("chars") + rules.template_chars)
    one = price(hit * rules.rounds, miss * rules.rounds, F.lit(COMPLETION[kind] * rules.rounds))
    return rows.groupBy("stream_id").agg(F.sum(one).alias(name))


def stage_costs(segments: DataFrame, members: DataFrame, clusters: DataFrame, targets: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row for each stream: main_usd, overlong_usd, review_{scope}_usd, missed_{strategy}_usd, after_{scope}_{strategy}_usd and segments.

    clusters (stream_id, match_ord, cluster) are the conflicts, targets
    (stream_id, lo, hi) the uncovered ranges. A cluster wider than most_window is
    not asked about. A review after a full audit leaves out clusters inside its
    targets. A full audit of a stream of more than most_segments may fall back,
    so it costs the windows times penalty besides.
    """
    running = _running(segments)
    size = running.groupBy("stream_id").agg(F.count("*").alias("segments"), F.max("chars").alias("whole"))
    batches = segments.groupBy("stream_id", F.floor(F.col("idx") / rules.lines).alias("b")).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    long = iv.expanded(cv.overlong(members, segments, rules.gap_s, rules.cap_s).select("stream_id", "lo", "hi"), segments, rules.context)
    ranges = rv.cluster_ranges(members, clusters).where(F.col("hi") - F.col("lo") + 1 <= rules.most_window).select("stream_id", "cluster", "lo", "hi")
    inside = rv.inside_targets(ranges.select("stream_id", "lo", "hi"), targets)
    later = ranges.join(inside, ["stream_id", "lo", "hi"], "left_anti")
    windows = iv.packed(targets.select("stream_id", "lo", "hi"), rules.pack).groupBy("stream_id", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    audits = targets.select("stream_id").distinct()

    local = lambda rows, name: _calls(_shown(iv.expanded(rows, segments, rules.context), running), rules, "review", name)
    full = lambda rows, name: _calls(rows.join(size, "stream_id"), rules, "review", name, whole=F.col("whole"))
    parts = [
        _calls(_shown(batches, running), rules, "main", "main_usd"), _calls(_shown(long, running), rules, "overlong", "overlong_usd"), local(ranges, "review_local_usd"), full(ranges, "review_full_usd"),
        local(later, "late_local_usd"), full(later, "late_full_usd"), _calls(_shown(iv.expanded(windows, segments, rules.context), running), rules, "missed_window", "missed_windowed_usd"),
        _calls(audits.join(size, "stream_id"), rules, "missed_full", "audit_usd", whole=F.col("whole")),
    ]
    out = size
    for p in parts:
        out = out.join(p, "stream_id", "left")
    out = out.fillna(0.0, [c for c in out.columns if c.endswith("_usd")])
    fallback = F.when(F.col("segments") > rules.most_segments, F.col("missed_windowed_usd") * rules.penalty).otherwise(0.0)
    return out.select(
        "stream_id", "segments", "main_usd", "overlong_usd", "review_local_usd", "review_full_usd", "missed_windowed_usd", (F.col("audit_usd") + fallback).alias("missed_full_transcript_usd"),
        F.col("review_local_usd").alias("after_local_windowed_usd"), F.col("review_full_usd").alias("after_full_windowed_usd"), F.col("late_local_usd").alias("after_local_full_transcript_usd"), F.col("late_full_usd").alias("after_full_full_transcript_usd"),
    )


def joint_choice(costs: DataFrame, rules: Rules = Rules(), *, scopes: tuple[str, ...] = SCOPES, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """(stream_id, scope, strategy, usd, reason): the pair with the least sum of the five costs, the first of equal ones; the cautious pair (the first scope and strategy) where it costs within margin of that."""
    pairs = [(s, m) for s in scopes for m in strategies]
    usd = lambda s, m: F.col("main_usd") + F.col(f"review_{s}_usd") + F.col("overlong_usd") + F.col(f"missed_{m}_usd") + F.col(f"after_{s}_{m}_usd")
    options = F.array(*(F.struct(usd(s, m).alias("usd"), F.lit(k).alias("k"), F.lit(s).alias("scope"), F.lit(m).alias("strategy")) for k, (s, m) in enumerate(pairs)))
    rows = costs.withColumn("options", options).withColumn("best", F.array_min("options")).withColumn("safe", F.get("options", F.lit(0)))
    near = (F.col("safe.usd") - F.col("best.usd")) / F.greatest("safe.usd", "best.usd", F.lit(1e-9)) < rules.margin
    picked = F.when(near, F.col("safe")).otherwise(F.col("best"))
    reason = F.when(F.col("best.k") == 0, "cheapest").when(near, "within_margin").otherwise("cheapest")
    return rows.withColumn("picked", picked).select("stream_id", "picked.scope", "picked.strategy", "picked.usd", reason.alias("reason"))
