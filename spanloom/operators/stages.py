"""Compositions: normalisation, boundary risk, adjudication stages, and word segmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import coverage as cv, intervals as iv, matches as mt
from spanloom.operators.folds import scan
from spanloom.operators.intervals import MATCH
from spanloom.sources.checkpoints import dealt


@dataclass(frozen=True)
class Chorus:
    """A split that keeps choruses: gaps up to gap_s seconds do not cut where the ``context`` texts on both sides are alike."""

    gap_s: float = 120.0
    likeness: float = 0.3
    context: int = 3


class Normalised(NamedTuple):
    members: DataFrame  # in order of first index, with the columns that were carried
    flags: DataFrame  # (stream_id, match_ord, reason): parts of split matches, and those too long
    events: DataFrame  # (stream_id, type, source_ord, title, ranges, seconds)


def split(members: DataFrame, segments: DataFrame, gap_s: float, chorus: Chorus | None = None) -> DataFrame:
    """Members with times, text and part: cut at gaps, by one of two rules."""
    if chorus is None:
        return iv.split_at_gaps(members, segments, gap_s)
    return cv.split_by_chorus(members, segments, gap_s, chorus.gap_s, chorus.likeness, chorus.context)


def _renumbered(parts: DataFrame) -> DataFrame:
    """Parts as matches of their own, in order of first index; source_ord and part say where they come from, several whether there are others."""
    match = Window.partitionBy(*MATCH)
    order = Window.partitionBy("stream_id").orderBy("first_idx", "match_ord", "part")
    rows = parts.withColumn("first_idx", F.min("idx").over(Window.partitionBy(*MATCH, "part"))).withColumn("several", F.min("part").over(match) < F.max("part").over(match))
    rows = rows.withColumn("source_ord", F.col("match_ord")).withColumn("new", (F.dense_rank().over(order) - 1).cast("long"))
    return rows.withColumn("match_ord", F.col("new")).drop("new", "first_idx")


def _ranges_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ranges) such as 1-3,7-9."""
    r = F.transform(F.sort_array(F.collect_list(F.struct("lo", "hi"))), lambda x: F.concat_ws("-", x["lo"], x["hi"]))
    return iv.index_ranges(rows, keys).groupBy(*keys).agg(F.array_join(r, ",").alias("ranges"))


def normalised(members: DataFrame, segments: DataFrame, *, gap_s: float, cap_s: float, chorus: Chorus | None = None, merge_neighbours: float | None = None, carry: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Normalised:
    """Matches split by one of two rules, duplicates dropped, optionally merged with neighbours of their title, in order of first index, with flags and events.

    Events are invalid_range (no segment of the match exists), disjoint_ranges
    (with the parts' ranges, parts separated by semicolons), exact_duplicate,
    overlong (with seconds; a cap of 0 or less is none) and merged_same_title (a
    row for each stream, ranges telling numbers before and after). carry names
    columns that stay with their match; a merged match has those of the one that
    gives its title. keep may store the split rows, which all results read.
    """
    own = ["stream_id", "match_ord", "title", "confidence", *carry]
    rows = _renumbered(split(members, segments, gap_s, chorus))
    parts = keep(rows.select(*own, "idx", "several", "source_ord", "part"))
    kept = mt.drop_duplicates(parts)
    long = mt.measures(kept.select(*own, "idx"), segments).where(F.lit(cap_s > 0) & (F.col("duration_s") > cap_s))
    flags = kept.where("several").select(*MATCH, F.lit("split").alias("reason")).distinct().union(long.select(*MATCH, F.lit("over_long").alias("reason")))
    out = kept.select(*own, "idx")

    source = parts.groupBy(*MATCH).agg(F.first("source_ord").alias("source_ord"), F.first("title").alias("title"), F.first("part").alias("part"), F.first("several").alias("several"))
    text = _ranges_text(parts, MATCH).join(source, MATCH)
    nothing = F.lit(None).cast("double").alias("seconds")
    gone = mt.heads(members).join(source.select("stream_id", F.col("source_ord").alias("match_ord")), MATCH, "left_anti")
    invalid = gone.select("stream_id", F.lit("invalid_range").alias("type"), F.col("match_ord").alias("source_ord"), "title", F.lit("").alias("ranges"), nothing)
    together = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ranges"))), lambda x: x["ranges"]), ";")
    disjoint = text.where("several").groupBy("stream_id", "source_ord").agg(F.first("title").alias("title"), together.alias("ranges")).select("stream_id", F.lit("disjoint_ranges"), "source_ord", "title", "ranges", nothing)
    twice = text.join(kept.select(*MATCH).distinct(), MATCH, "left_anti").select("stream_id", F.lit("exact_duplicate"), "source_ord", "title", "ranges", nothing)
    over = long.join(text.select(*MATCH, "source_ord", "ranges"), MATCH).select("stream_id", F.lit("overlong"), "source_ord", "title", "ranges", F.col("duration_s"))
    events = invalid.union(disjoint).union(twice).union(over)
    if merge_neighbours is not None:
        merged = mt.merge_same_title(out, segments, merge_neighbours, neighbours_only=True, carry=carry)
        n = lambda df, c: df.groupBy("stream_id").agg(F.count_distinct("match_ord").alias(c))
        fewer = n(out, "b").join(n(merged, "a"), "stream_id").where("a < b")
        events = events.union(fewer.select("stream_id", F.lit("merged_same_title"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.concat_ws(">", "b", "a"), nothing))
        out = merged
    return Normalised(out, flags, events)


def normalise(members: DataFrame, segments: DataFrame, *, gap_s: float, cap_s: float, merge_neighbours: float | None = None, chorus: Chorus | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(members, flags) of normalised()."""
    found = normalised(members, segments, gap_s=gap_s, cap_s=cap_s, merge_neighbours=merge_neighbours, chorus=chorus, keep=keep)
    return found.members, found.flags


class Repaired(NamedTuple):
    members: DataFrame
    records: DataFrame  # risk of every match
    events: DataFrame  # (stream_id, type, source_ord, title, before, ranges, seconds)


def boundary_risk(members: DataFrame, segments: DataFrame, *, gap_s: float, cap_s: float, risk: dict[str, Any] | None = None, chorus: Chorus | None = None, merge_neighbours: float | None = None, preserve: bool = False, carry: tuple[str, ...] = ()) -> Repaired:
    """Boundary repair, normalisation and risk scores as one stage, with the event rows of the first two.

    preserve leaves out the repair. risk holds the settings of matches.risks. The
    rows that several results need are kept once (an eager action).
    """
    columns = ["stream_id", "match_ord", "title", "confidence", *carry, "idx"]
    repaired, events = members.select(*columns), None
    if not preserve:
        parts = dealt(_renumbered(split(members, segments, gap_s, chorus)).select(*columns, "source_ord", "part", "several"))
        repaired = parts.select(*columns)
        text = _ranges_text(parts.where("several"), ["stream_id", "source_ord", "part"]).groupBy("stream_id", "source_ord")
        after = text.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ranges"))), lambda x: x["ranges"]), ";").alias("ranges"))
        before = _ranges_text(parts.where("several"), ["stream_id", "source_ord"]).withColumnRenamed("ranges", "before")
        names = parts.groupBy("stream_id", "source_ord").agg(F.first("title").alias("title"))
        events = after.join(before, ["stream_id", "source_ord"]).join(names, ["stream_id", "source_ord"])
        events = events.select("stream_id", F.lit("risk_boundary_split").alias("type"), "source_ord", "title", "before", "ranges", F.lit(None).cast("double").alias("seconds"))
    n = normalised(repaired, segments, gap_s=gap_s, cap_s=cap_s, chorus=chorus, merge_neighbours=merge_neighbours, carry=carry)
    out = dealt(n.members)
    more = n.events.select("stream_id", "type", "source_ord", "title", F.lit("").alias("before"), "ranges", "seconds")
    return Repaired(out, mt.risks(out.select("stream_id", "match_ord", "title", "confidence", "idx"), segments, **(risk or {})), more if events is None else events.union(more))


def adjudicate(members: DataFrame, segments: DataFrame, suspicious: DataFrame, searched: DataFrame, *, span: int, cap_s: float) -> DataFrame:
    """Members without those that lose to better evidence in their conflict cluster."""
    cluster = mt.clusters(mt.conflict_edges(members, suspicious, span=span), suspicious)
    lost = mt.select_best(members, cluster, segments, searched, cap_s).where("action = 'discard'").select(*MATCH)
    return members.join(lost, MATCH, "left_anti")


def final_adjudication(members: DataFrame, segments: DataFrame, searched: DataFrame, *, gap_s: float, span: int, cap_s: float, chorus: Chorus | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Normalise, then settle the conflicts of different titles; no match is suspicious in itself. The normalised rows are kept once (an eager action)."""
    rows = dealt(normalised(members, segments, gap_s=gap_s, cap_s=cap_s, chorus=chorus, carry=carry).members)
    return adjudicate(rows, segments, mt.heads(rows).where("false"), searched, span=span, cap_s=cap_s)


def residual_pass(members: DataFrame, segments: DataFrame, searched: DataFrame, *, span: int, cap_s: float, merge_s: float | None = None) -> DataFrame:
    """Conflicts left after a review, with nothing suspicious in itself; then titles merged, if merge_s is given."""
    out = adjudicate(members, segments, mt.heads(members).where("false"), searched, span=span, cap_s=cap_s)
    return mt.merge_same_title(out, segments, merge_s) if merge_s is not None else out


def finish_recheck(base: DataFrame, extra: DataFrame, segments: DataFrame, *, gap_s: float, cap_s: float, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Base and additional matches as one list, normalised and merged by title."""
    shift = base.groupBy("stream_id").agg((F.max("match_ord") + 1).alias("shift"))
    more = extra.join(shift, "stream_id", "left").withColumn("match_ord", F.col("match_ord") + F.coalesce("shift", F.lit(0))).select(*base.columns)
    rows, _ = normalise(base.unionByName(more), segments, gap_s=gap_s, cap_s=cap_s, keep=keep)
    return mt.merge_same_title(rows, segments, gap_s)


def candidate_matches(candidates: DataFrame, tag: str) -> DataFrame:
    """Candidates (stream_id, id, anchor, lo, hi) as matches named after their anchor text, or else their id."""
    text = F.coalesce(F.nullif(F.trim("anchor"), F.lit("")), "id")
    return candidates.select("stream_id", "id", F.concat(F.lit("未知歌曲："), text).alias("title"), F.concat_ws(",", F.lit(tag), "id").alias("tags"), "lo", "hi")


def words_to_segments(words: DataFrame, *, gap_s: float, cap_s: float) -> DataFrame:
    """Segments of words (stream_id, word_idx, start_s, end_s, word): cut at gaps above gap_s and before growing longer than cap_s.

    Words without times or text drop out. The cap depends on where a segment
    began, so it is a fold, which carries the open segment on.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        start, before, said = None, None, []
        for _, begin, end, word in rows:
            if said and (begin - before > gap_s or end - start > cap_s):
                yield start, before, "".join(said)
                said = []
            if not said:
                start = begin
            before = end
            said.append(word)
        if said:
            yield start, before, "".join(said)

    good = words.where("start_s is not null and end_s is not null and trim(word) <> ''").select("stream_id", "word_idx", "start_s", "end_s", "word")
    out = scan(good, ["stream_id"], ["word_idx", "start_s", "end_s", "word"], fold, "start_s double, end_s double, text string")
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy("start_s", "end_s")) - 1
    return out.select("stream_id", n.cast("long").alias("idx"), "start_s", "end_s", "text")


def search_budget(members: DataFrame, most: int) -> DataFrame:
    """The first ``most`` matches of each stream without a name: those to look up."""
    from spanloom.functions.scalars import unknown_title

    order = Window.partitionBy("stream_id").orderBy("lo", "match_ord")
    rows = mt.heads(members).where(unknown_title(F.col("title")) | (F.col("confidence") < 0.5))
    return rows.withColumn("k", F.row_number().over(order).cast("long")).where(F.col("k") <= most).select(*MATCH, "k")


def scan_windows(targets: DataFrame, size: int) -> DataFrame:
    """Targets in windows of size segments, with ids that run through a stream."""
    return iv.numbered(iv.chunked(targets, size), "W").select("stream_id", "lo", "hi", "id")


def first_gap(segments: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """The first uncovered range of each stream that is long enough."""
    first = iv.uncovered(segments, members, least).groupBy("stream_id").agg(F.min(F.struct("lo", "hi")).alias("r"))
    return first.select("stream_id", "r.lo", "r.hi")
