"""Three rounds of segmentation over tables of responses: discovery, recall, adjudication.

Ranges are long: a row for each range of an object. Decisions are (stream_id,
dec, action, id, lo, hi, confidence) with a row for each candidate id and range;
reasons name the first failing rule of a stream, or are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.intervals import MATCH, numbered, range_seconds, uncovered

ACTIONS = ("accept", "reject", "adjust", "split", "merge")


def discovery(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """Candidates from raw ranges (stream_id, obj, lo, hi, confidence, anchor): clamped, those of equal ranges once, numbered P001 by position."""
    size = segments.groupBy("stream_id").agg(F.count("*").alias("n"))
    cut = ranges.join(size, "stream_id").select("stream_id", "obj", F.greatest("lo", F.lit(0).cast("long")).alias("lo"), F.least("hi", F.col("n") - 1).alias("hi"), "confidence", F.substring(F.trim("anchor"), 1, 200).alias("anchor")).where("lo <= hi")
    objects = cut.groupBy("stream_id", "obj").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"), F.min("confidence").alias("confidence"), F.min("anchor").alias("anchor"))
    once = objects.withColumn("k", F.row_number().over(Window.partitionBy("stream_id", "ranges").orderBy("obj"))).where("k = 1").drop("k")
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.get("ranges", 0), "obj"))
    return once.withColumn("id", F.format_string("P%03d", n))


def discovery_reason(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """(stream_id, reason) of (stream_id, complete, raw_objects): incomplete, or objects without a valid range."""
    kept = candidates.groupBy("stream_id").agg(F.count("*").alias("kept"))
    r = responses.join(kept, "stream_id", "left")
    return r.select("stream_id", F.when(~F.col("complete"), "discovery_incomplete").when((F.col("raw_objects") > 0) & F.col("kept").isNull(), "discovery_without_ranges").alias("reason"))


def recall_targets(segments: DataFrame, members: DataFrame, least_s: float = 10.0) -> DataFrame:
    """Uncovered ranges of at least least_s seconds (0 counts as 10), numbered U001."""
    timed = range_seconds(uncovered(segments, members), segments).where(F.col("seconds") >= (least_s or 10.0))
    return numbered(timed, "U").select("stream_id", F.col("id").alias("target"), "lo", "hi")


def recall_anchors(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """Anchors (stream_id, obj, target, lo, hi, confidence) cropped to their target, equal ones once, numbered R001."""
    t = targets.select("stream_id", "target", F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    cut = anchors.join(t, ["stream_id", "target"]).select("stream_id", "obj", "target", F.greatest("lo", "tlo").alias("lo"), F.least("hi", "thi").alias("hi"), "confidence").where("lo <= hi")
    once = cut.withColumn("k", F.row_number().over(Window.partitionBy("stream_id", "target", "lo", "hi").orderBy("obj"))).where("k = 1").drop("k")
    return once.withColumn("id", F.format_string("R%03d", F.row_number().over(Window.partitionBy("stream_id").orderBy("lo", "hi", "obj"))))


def recall_reason(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """(stream_id, reason) of the first bad anchor in order: unknown target, or evidence outside it."""
    t = targets.select("stream_id", "target", F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    bad = F.when(F.col("tlo").isNull(), "recall_unknown_target").when((F.col("lo") < F.col("tlo")) | (F.col("hi") > F.col("thi")), "recall_evidence_outside_target")
    rows = anchors.join(t, ["stream_id", "target"], "left").withColumn("bad", bad)
    return rows.groupBy("stream_id").agg(F.min(F.when(F.col("bad").isNotNull(), F.struct("obj", "bad")))["bad"].alias("reason"))


def additions_with_evidence(additions: DataFrame, segments: DataFrame, least_s: float = 10.0) -> DataFrame:
    """(stream_id, add, final_discovery, confidence, anchor, indices, enough) of additions.

    additions has a row for each range (stream_id, add, kind, lo, hi,
    final_discovery, confidence, anchor), kind being evidence or final. There is
    enough evidence for an addition that is marked as a final discovery, has a
    final range, and whose evidence has two segments at least, or one of least_s seconds.
    """
    size = segments.groupBy("stream_id").agg(F.count("*").alias("n"))
    cut = additions.join(size, "stream_id", "left").withColumn("lo", F.greatest("lo", F.lit(0).cast("long"))).withColumn("hi", F.least("hi", F.col("n") - 1))
    ids = cut.withColumn("idx", F.explode_outer(F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi"))))
    seconds = segments.select("stream_id", "idx", (F.col("end_s") - F.col("start_s")).alias("seconds"))
    every = ids.join(seconds, ["stream_id", "idx"], "left").groupBy("stream_id", "add").agg(
        F.bool_and(F.coalesce("final_discovery", F.lit(False))).alias("final_discovery"), F.max("confidence").alias("confidence"), F.substring(F.trim(F.max("anchor")), 1, 200).alias("anchor"),
        F.array_compact(F.collect_set(F.when(F.col("kind") == "final", F.col("idx")))).alias("indices"), F.count_distinct(F.when(F.col("kind") == "evidence", F.col("idx"))).alias("shown"), F.max(F.when(F.col("kind") == "evidence", F.col("seconds"))).alias("seconds"),
    )
    enough = F.col("final_discovery") & (F.size("indices") > 0) & ((F.col("shown") >= 2) | F.coalesce(F.col("seconds") >= least_s, F.lit(False)))
    return every.withColumn("enough", enough).drop("shown", "seconds")


def adjudication_reason(decisions: DataFrame, candidates: DataFrame, additions: DataFrame | None = None, segments: DataFrame | None = None, complete: DataFrame | None = None, *, most_additions: int = 10) -> DataFrame:
    """(stream_id, reason) of each stream's adjudication.

    First a stream that (stream_id, complete) does not call complete, then each
    decision's rules in order, repeated and missing ids, and, where additions and
    segments are given, too many additions and such without evidence.
    """
    out = _decision_reason(decisions, candidates)
    if additions is not None:
        each = additions_with_evidence(additions, segments).groupBy("stream_id").agg(F.count("*").alias("adds"), F.bool_and("enough").alias("shown"))
        late = F.when(F.col("adds") > most_additions, "too_many_additions").when(~F.col("shown"), "addition_without_evidence")
        out = out.join(each, "stream_id", "full").select("stream_id", F.coalesce("reason", late).alias("reason"))
    if complete is not None:
        out = out.join(complete, "stream_id", "full").select("stream_id", F.when(~F.coalesce("complete", F.lit(False)), "incomplete").otherwise(F.col("reason")).alias("reason"))
    return out


def _decision_reason(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    known = candidates.select("stream_id", "id").distinct().withColumn("known", F.lit(True))
    rows = decisions.join(known, ["stream_id", "id"], "left")
    each = rows.groupBy("stream_id", "dec").agg(
        F.first("action").alias("action"), F.count_distinct("id").alias("ids"), F.bool_or(F.col("id").isNotNull() & F.col("known").isNull()).alias("unknown"), F.count("lo").alias("ranges"),
    )
    bad = (
        F.when(~F.col("action").isin(*ACTIONS), "invalid_action").when(F.col("ids") == 0, "missing_ids").when(F.col("unknown"), "unknown_id")
        .when((F.col("action") == "merge") & (F.col("ids") < 2), "invalid_merge").when((F.col("action") != "merge") & (F.col("ids") != 1), "multi_id_non_merge")
        .when((F.col("action") == "reject") & (F.col("ranges") > 0), "reject_has_ranges").when((F.col("action") != "reject") & (F.col("ranges") == 0), "missing_ranges")
    )
    first = each.withColumn("bad", bad).groupBy("stream_id").agg(F.min(F.when(F.col("bad").isNotNull(), F.struct("dec", "bad")))["bad"].alias("bad"))
    uses = decisions.where("id is not null").select("stream_id", "dec", "id").distinct().groupBy("stream_id", "id").agg(F.count("*").alias("uses"))
    cover = known.select("stream_id", "id").join(uses, ["stream_id", "id"], "left").groupBy("stream_id").agg(F.max(F.coalesce("uses", F.lit(0))).alias("most"), F.count_if(F.col("uses").isNull()).alias("missing"))
    out = cover.join(first, "stream_id", "left")
    return out.select("stream_id", F.coalesce("bad", F.when(F.col("most") > 1, "duplicate_id").when(F.col("missing") > 0, "missing_id")).alias("reason"))


def apply_decisions(decisions: DataFrame, candidates: DataFrame, additions: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Final matches in long form: rejected candidates drop out, the others take their decision's ranges and the first anchor text of their sources.

    Additions with enough evidence follow, numbered after the stream's last decision.
    """
    kept = decisions.where("action <> 'reject' and lo is not null")
    names = kept.select("stream_id", "dec", "id").distinct().join(candidates.select("stream_id", "id", "anchor"), ["stream_id", "id"])
    anchor = names.groupBy("stream_id", "dec").agg(F.min(F.when(F.col("anchor") != "", F.struct("id", "anchor")))["anchor"].alias("anchor"), F.min("id").alias("id"))
    ids = kept.select("stream_id", "dec", "confidence", F.explode(F.sequence("lo", "hi")).alias("idx")).distinct()
    title = F.concat(F.lit("未知歌曲："), F.coalesce("anchor", "id"))
    decided = ids.join(anchor, ["stream_id", "dec"]).select("stream_id", F.col("dec").alias("match_ord"), title.alias("title"), "confidence", "idx")
    if additions is None:
        return decided
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("add"))
    added = additions_with_evidence(additions, segments).where("enough").withColumn("place", place).join(decisions.groupBy("stream_id").agg(F.max("dec").alias("last")), "stream_id", "left")
    own = F.concat(F.lit("未知歌曲："), F.coalesce(F.nullif("anchor", F.lit("")), F.lit("final_discovery")))
    return decided.union(added.select("stream_id", (F.coalesce("last", F.lit(0)) + F.col("place")).cast("long"), own, "confidence", F.explode("indices")))


def evidence_enough(anchors: DataFrame, segments: DataFrame, least_s: float = 10.0) -> DataFrame:
    """Anchors (stream_id, obj, lo, hi) of two segments at least, or of least_s seconds."""
    return range_seconds(anchors, segments).where((F.col("hi") > F.col("lo")) | (F.col("seconds") >= least_s)).drop("seconds")


def thin(members: DataFrame, most: int) -> DataFrame:
    """At most ``most`` segments of each match: a third each from its head, its middle and its end."""
    part = max(1, most // 3)
    ids = members.groupBy(*MATCH).agg(F.sort_array(F.collect_set("idx")).alias("ids"))
    n = F.size("ids")
    middle = F.greatest(F.lit(1), F.floor((n - part) / 2).cast("int") + 1)
    some = F.array_union(F.array_union(F.slice("ids", 1, part), F.slice("ids", middle, part)), F.slice("ids", F.greatest(F.lit(1), n - part + 1), part))
    return ids.select(*MATCH, F.explode(F.when(n <= most, F.col("ids")).otherwise(F.sort_array(some))).alias("idx"))


def remaining(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates that a cut-off answer has not decided yet."""
    return candidates.select("stream_id", "id").join(decisions.select("stream_id", "id").distinct(), ["stream_id", "id"], "left_anti")


def resume_points(ranges: DataFrame, overlap: int = 5) -> DataFrame:
    """Where a cut-off discovery goes on: overlap segments before the end of its last candidate."""
    return ranges.groupBy("stream_id").agg(F.greatest(F.lit(0).cast("long"), F.max("hi") - overlap + 1).alias("resume"))
