"""Evaluation of a profile's matches against weak truth, and the gates a profile has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.scalars import price, title_key, unknown_prefix
from spanloom.operators import matches as mt
from spanloom.operators.intervals import MATCH, cover_compare, index_ranges, overlap_pairs

#: Bounds of the gates and of the seconds that are no outlier.
MOST_COST, LEAST_PRECISION, LEAST_RECALL, MOST_ERROR = 0.9, 0.80, 0.90, 0.15
SHORT_S, LONG_S = 150.0, 360.0
GATES = (
    "cost_at_most_90_percent_of_accuracy",
    "temporal_coverage_precision_at_least_80_percent",
    "temporal_coverage_recall_at_least_90_percent",
    "no_fixture_overlong_regressions",
    "no_exact_duplicates",
    "no_different_title_overlap",
    "no_same_title_overlap",
)


def weak_truth(baseline: DataFrame, least: float = 0.6) -> DataFrame:
    """Members of the baseline's matches that are confident enough."""
    return baseline.where(F.col("confidence") >= least)


def _of(rows: DataFrame, *aggregates) -> DataFrame:
    return rows.groupBy("stream_id").agg(*aggregates)


def duration_outliers(members: DataFrame, segments: DataFrame) -> DataFrame:
    """(stream_id, match_ord, title, duration_s, ranges) of matches shorter or longer than a song is as a rule; a hint, not a rule."""
    m = mt.measures(members, segments).where((F.col("duration_s") < SHORT_S) | (F.col("duration_s") > LONG_S))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", "hi"))), lambda x: F.concat_ws("-", x["lo"], x["hi"])), ",")
    ranges = index_ranges(members, MATCH).groupBy(*MATCH).agg(text.alias("ranges"))
    return m.select(*MATCH, "title", "duration_s").join(ranges, MATCH)


def profile_metrics(members: DataFrame, segments: DataFrame, anchors: DataFrame, usage: DataFrame, *, estimates: DataFrame | None = None, protected: DataFrame | None = None, watched: DataFrame | None = None, hit: float = 0.5) -> DataFrame:
    """A row for each stream with segments: every metric of a profile.

    anchors are members of the weak truth, usage has (stream_id, hit, miss,
    completion), estimates (stream_id, estimated_usd); protected titles (title)
    are looked for, watched ones (title) are regressions where longer than LONG_S.
    Ratios without a denominator are null.
    """
    h = mt.heads(members).withColumn("key", title_key(F.col("title")))
    sets = members.groupBy(*MATCH).agg(F.sort_array(F.collect_set("idx")).alias("ids")).join(h.select(*MATCH, "key"), MATCH)
    twice = sets.groupBy("stream_id", "key", "ids").agg((F.count("*") - 1).alias("more"))
    counts = _of(h, F.count("*").alias("matches"), F.count_if(unknown_prefix(F.col("title"))).alias("unknown_titles"))

    side = lambda c: h.select("stream_id", F.col("match_ord").alias(c), F.col("key").alias(f"k{c}"))
    pairs = overlap_pairs(members).join(side("a"), ["stream_id", "a"]).join(side("b"), ["stream_id", "b"])
    overlaps = _of(pairs, F.count_if(F.col("ka") != F.col("kb")).alias("different_title_overlaps"), F.count_if(F.col("ka") == F.col("kb")).alias("same_title_overlaps"))

    a = mt.heads(anchors).withColumn("akey", title_key(F.col("title")))
    best = a.select(*MATCH, "n", "akey").join(mt.best_overlap(anchors, members), MATCH, "left")
    near = F.coalesce(F.col("shared"), F.lit(0)) >= hit * F.col("n")
    found = _of(best, F.count("*").alias("anchors"), F.count_if(near).alias("anchor_hits"), F.count_if(near & (F.col("akey") == title_key(F.col("o_title")))).alias("title_agreements"))
    met = anchors.select("stream_id", "idx", F.col("match_ord").alias("anchor")).join(members.select("stream_id", "idx", "match_ord"), ["stream_id", "idx"]).select("stream_id", "anchor", "match_ord").distinct()
    met = met.join(a.select("stream_id", F.col("match_ord").alias("anchor"), "akey"), ["stream_id", "anchor"])
    fragmented = _of(met.groupBy("stream_id", "anchor").agg(F.count("*").alias("n")), F.count_if(F.col("n") > 1).alias("fragmented_anchors"))
    held = met.groupBy(*MATCH).agg(F.count("*").alias("n"), F.count_distinct("akey").alias("titles"))
    coalesced = _of(held, F.count_if(F.col("n") > 1).alias("coalesced_anchors"), F.count_if(F.col("titles") > 1).alias("mixed_title_coalesced"))
    cover = cover_compare(members, anchors)

    spent = _of(usage, F.sum("hit").alias("hit"), F.sum("miss").alias("miss"), F.sum("completion").alias("completion"))
    out = segments.select("stream_id").distinct()
    parts = [counts, _of(twice, F.sum("more").alias("exact_duplicates")), overlaps, found, fragmented, coalesced, cover, _of(duration_outliers(members, segments), F.count("*").alias("duration_outliers"))]
    if watched is not None:
        keys = watched.select(title_key(F.col("title")).alias("key")).distinct()
        long = mt.measures(members, segments).where(F.col("duration_s") > LONG_S).withColumn("key", title_key(F.col("title"))).join(keys, "key", "left_semi")
        parts.append(_of(long, F.count("*").alias("overlong_regressions")))
    if protected is not None:
        keys = protected.select(title_key(F.col("title")).alias("key")).distinct()
        parts.append(_of(h.join(keys, "key", "left_semi"), F.count_distinct("key").alias("protected_found")))
    for p in parts:
        out = out.join(p, "stream_id", "left")
    counted = [c for c in out.columns if c != "stream_id"] + [c for c in ("overlong_regressions", "protected_found") if c not in out.columns]
    out = out.select("stream_id", *((F.coalesce(c, F.lit(0)) if c in out.columns else F.lit(0)).cast("long").alias(c) for c in counted)).join(spent, "stream_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    out = out.select(
        "*", (F.col("matches") - F.col("unknown_titles")).alias("known_titles"), F.try_divide("anchor_hits", "anchors").alias("anchor_recall"),
        F.try_divide(F.col("both"), F.col("both") + F.col("only_left")).alias("coverage_precision"), F.try_divide(F.col("both"), F.col("both") + F.col("only_right")).alias("coverage_recall"),
        F.try_divide(n("hit"), n("hit") + n("miss")).alias("cache_hit_ratio"), price(n("hit"), n("miss"), n("completion")).alias("cost_usd"),
    ).drop("both", "only_left", "only_right", "hit", "miss", "completion")
    if estimates is not None:
        off = F.try_divide(F.abs(F.col("cost_usd") - F.col("estimated_usd")), F.col("estimated_usd"))
        out = out.join(estimates.select("stream_id", "estimated_usd"), "stream_id", "left").withColumn("estimate_error", off).withColumn("estimate_valid", off <= MOST_ERROR)
    return out


def gates(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(stream_id, the seven gates, passes_all_gates) of a profile's metrics against the baseline profile's; a stream without a baseline cost fails the first gate."""
    b = baseline.select("stream_id", F.col("cost_usd").alias("base"))
    rules = [
        F.coalesce((F.col("base") > 0) & (F.col("cost_usd") <= F.col("base") * MOST_COST), F.lit(False)), F.coalesce(F.col("coverage_precision") >= LEAST_PRECISION, F.lit(False)),
        F.coalesce(F.col("coverage_recall") >= LEAST_RECALL, F.lit(False)), F.col("overlong_regressions") == 0, F.col("exact_duplicates") == 0, F.col("different_title_overlaps") == 0, F.col("same_title_overlaps") == 0,
    ]
    rows = candidate.join(b, "stream_id", "left").select("stream_id", *(r.alias(g) for r, g in zip(rules, GATES)))
    return rows.withColumn("passes_all_gates", F.expr(" and ".join(GATES)))


def best_profiles(verdicts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(stream_id, profile, cost_usd): of the profiles that pass all gates the cheapest for each stream, the first by name of equal ones; both tables carry profile."""
    good = verdicts.where("passes_all_gates").select("stream_id", "profile").join(metrics.select("stream_id", "profile", "cost_usd"), ["stream_id", "profile"])
    order = Window.partitionBy("stream_id").orderBy("cost_usd", "profile")
    return good.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
