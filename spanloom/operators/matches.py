"""Operators on candidate matches: same-title merges, risk, conflicts, evaluation, adjudication.

Members are matches in long form (stream_id, match_ord, title, confidence, idx);
segments are (stream_id, idx, start_s, end_s, text). match_ord is the order of
the list a match came from and breaks every tie.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.scalars import UNNAMED, title_key, unknown_title
from spanloom.operators.components import components_within
from spanloom.operators.folds import scan
from spanloom.operators.intervals import MATCH, overlap_pairs, timed
from spanloom.sources.checkpoints import dealt, few

#: Fixed value: the title of a range that no source names.
ADDED = "未知歌曲：时序裁决新增区间"


def heads(members: DataFrame) -> DataFrame:
    """One row for each match: (stream_id, match_ord, title, confidence, lo, hi, n)."""
    return members.groupBy(*MATCH).agg(F.first("title").alias("title"), F.first("confidence").alias("confidence"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count_distinct("idx").alias("n"))


def _with_ends(rows: DataFrame, segments: DataFrame) -> DataFrame:
    first = segments.select("stream_id", F.col("idx").alias("lo"), F.col("start_s").alias("lo_s"))
    last = segments.select("stream_id", F.col("idx").alias("hi"), F.col("end_s").alias("hi_s"))
    return rows.join(first, ["stream_id", "lo"]).join(last, ["stream_id", "hi"])


def merge_same_title(members: DataFrame, segments: DataFrame, gap_s: float, *, neighbours_only: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Merges a match into the nearest earlier one of its title, if at most gap_s lies between; members with grp, the merged match.

    The end of the group so far is the greatest index of its title before, so
    windows give the fold's result. Times that overlap leave no gap, so below zero
    gap_s joins only matches whose segments do. With neighbours_only a match of another
    title between two of them keeps them apart. The merged match takes title
    and confidence from its most confident member, the earlier one in a tie
    (the later one with neighbours_only), and the columns named by carry.
    """
    more = members.groupBy(*MATCH).agg(*(F.first(c).alias(c) for c in carry)) if carry else None
    rows = _with_ends(heads(members) if more is None else heads(members).join(more, MATCH), segments).withColumn("key", title_key(F.col("title")))
    keys = ["stream_id", "key"]
    order = Window.partitionBy("stream_id").orderBy("lo", "match_ord")
    if neighbours_only:
        change = F.when(F.lag("key").over(order) == F.col("key"), 0).otherwise(1)
        rows = rows.withColumn("change", change).withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        keys = ["stream_id", "key", "run"]
    own = Window.partitionBy(*keys).orderBy("lo", "match_ord")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.struct("hi", "hi_s")).over(past)
    cut = before.isNull() | ((F.col("lo") > before["hi"]) & (F.greatest(F.lit(0.0), F.col("lo_s") - before["hi_s"]) > gap_s))
    rows = rows.withColumn("cut", F.when(cut, 1).otherwise(0))
    rows = rows.withColumn("part", F.sum("cut").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(*keys, "part")
    sign = 1 if neighbours_only else -1
    best = F.max(F.struct("confidence", F.col("lo") * sign, F.col("match_ord") * sign, "title", *carry)).over(group)
    rows = rows.withColumn("grp", F.min(F.struct("lo", "match_ord")).over(group)["match_ord"]).withColumn("best", best)
    named = rows.select(*MATCH, "grp", F.col("best.title").alias("title"), F.col("best.confidence").alias("confidence"), *(F.col("best")[c].alias(c) for c in carry))
    return members.select(*MATCH, "idx").join(named, MATCH).select("stream_id", F.col("grp").alias("match_ord"), "title", "confidence", *carry, "idx").distinct()


def drop_duplicates(members: DataFrame) -> DataFrame:
    """Keeps the first of matches with equal title key and index set."""
    sets = members.groupBy(*MATCH).agg(F.first("title").alias("title"), F.sort_array(F.collect_set("idx")).alias("ids"))
    order = Window.partitionBy("stream_id", title_key(F.col("title")), "ids").orderBy("match_ord")
    first = sets.withColumn("k", F.row_number().over(order)).where("k = 1").select(*MATCH)
    return members.join(first, MATCH, "left_semi")


def measures(members: DataFrame, segments: DataFrame) -> DataFrame:
    """heads with duration, speech seconds and the longest inner gap."""
    order = Window.partitionBy(*MATCH).orderBy("idx")
    rows = timed(members, segments).withColumn("gap", F.greatest(F.lit(0.0), F.lead("start_s").over(order) - F.col("end_s")))
    speech = F.sum(F.round(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s")) * 1e6).cast("long"))
    sums = rows.groupBy(*MATCH).agg((speech / F.lit(1e6)).alias("speech_s"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap_s"))
    ends = _with_ends(heads(members), segments)
    return ends.withColumn("duration_s", F.greatest(F.lit(0.0), F.col("hi_s") - F.col("lo_s"))).join(sums, MATCH)


def risks(members: DataFrame, segments: DataFrame, *, soft_min: float = 150.0, soft_max: float = 360.0, gap: float = 20.0, low: float = 0.65, weights: tuple[float, float, float, float] = (1.0, 2.0, 2.0, 2.0), review: float = 0.55, reject: float = 0.9) -> DataFrame:
    """Risk of every match: four features, score, reasons and action.

    Other matches count in list order until the first of another title that
    shares a segment; farther matches of the same title count if they come before it.
    """
    m = measures(members, segments).withColumn("key", title_key(F.col("title")))
    names = m.select("stream_id", F.col("match_ord").alias("o"), F.col("key").alias("okey"))
    pairs = overlap_pairs(members)
    both = pairs.select("stream_id", F.col("a").alias("match_ord"), F.col("b").alias("o")).union(pairs.select("stream_id", F.col("b"), F.col("a")))
    crossed = both.join(names, ["stream_id", "o"]).join(m.select(*MATCH, "key"), MATCH).where("key <> okey").groupBy(*MATCH).agg(F.min("o").alias("stop"))
    # Another match of the title lies apart if it ends before the first or begins behind the last segment. Of those in
    # list order before ``stop`` the one that ends first and the one that begins last lie farthest, as times grow with
    # the index; running extremes up to that place tell them, and the match itself never qualifies.
    both_kinds = F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("match_ord").alias("place")), F.struct(F.lit(0).alias("kind"), F.coalesce("stop", F.lit(2**62)).alias("place"))))
    placed = m.join(crossed, MATCH, "left").select("stream_id", "key", both_kinds.alias("k"), "match_ord", "lo", "hi", "lo_s", "hi_s").select("*", "k.kind", "k.place")
    before = Window.partitionBy("stream_id", "key").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda *c: F.when(F.col("kind") == 1, F.struct(*c))
    reach = placed.withColumn("early", F.min(of("hi", "hi_s")).over(before)).withColumn("late", F.max(of("lo", "lo_s")).over(before)).where("kind = 0")
    far = F.greatest(F.when(F.col("early.hi") < F.col("lo"), F.col("lo_s") - F.col("early.hi_s")), F.when(F.col("late.lo") > F.col("hi"), F.col("late.lo_s") - F.col("hi_s")))
    distant = reach.select(*MATCH, far.alias("far")).where(F.col("far") > gap)

    def unit(c: Column) -> Column:
        return F.least(F.lit(1.0), c)

    d = F.col("duration_s")
    short, long = d < soft_min, d > soft_max
    duration = F.when(short, unit((soft_min - d) / soft_min)).when(long, unit((d - soft_max) / soft_max + 0.5)).otherwise(0.0)
    density = F.when(d > 0, 1.0 - unit(F.col("speech_s") / d)).otherwise(1.0)
    boundary = F.greatest(density, unit(F.col("max_gap_s") / gap))
    overlap = F.when(F.col("stop").isNotNull(), 1.0).when(F.col("far").isNotNull(), unit(F.col("far") / max(soft_max, 1.0))).otherwise(0.0)
    unknown = unknown_title(F.col("title"))
    evidence = F.greatest(F.lit(0.0), unit((low - F.col("confidence")) / max(low, 0.01)), F.when(unknown, 0.35).otherwise(0.25))
    rows = m.join(crossed, MATCH, "left").join(distant, MATCH, "left").select(*MATCH, "title", "duration_s", "far", "stop", short.alias("short"), long.alias("long"), unknown.alias("unknown"), duration.alias("duration"), boundary.alias("boundary"), overlap.alias("overlap"), evidence.alias("evidence"))
    score = sum(F.col(c) * w for c, w in zip(("duration", "boundary", "overlap", "evidence"), weights)) / (sum(weights) or 1.0)
    rows = rows.withColumn("score", score)
    wants = F.col("short") | F.col("long") | F.col("far").isNotNull() | (F.col("boundary") >= 0.75) | (F.col("score") >= review) | (F.col("overlap") > 0)
    action = F.when(F.col("score") >= reject, "review_requires_evidence").when(wants, "review").otherwise("accept")
    reasons = [
        (F.col("short"), "duration_below_soft_range"), (F.col("long"), "duration_above_soft_range"), (F.col("boundary") >= 0.5, "sparse_or_expanded_boundary"),
        (F.col("far").isNotNull(), "distant_same_title"), (F.col("stop").isNotNull(), "different_title_overlap"), (F.col("unknown"), "unknown_title"),
        (~F.col("unknown"), "title_without_lyric_evidence"), (F.col("score") >= reject, "high_risk_requires_evidence"),
    ]
    return rows.withColumn("action", action).withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in reasons)))).drop("far", "stop", "short", "long", "unknown")


def conflict_edges(members: DataFrame, suspicious: DataFrame, *, span: int = 500, nearby: int = -1) -> DataFrame:
    """(stream_id, a, b): different titles that share a segment or, if nearby is not negative, lie at most that many segments apart; suspicious matches of one title within span."""
    h = heads(members).withColumn("key", title_key(F.col("title"))).join(suspicious.select(*MATCH).distinct().withColumn("s", F.lit(True)), MATCH, "left")
    a = h.select("stream_id", F.col("match_ord").alias("a"), F.col("key").alias("ka"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("s").alias("sa"))
    b = h.select("stream_id", F.col("match_ord").alias("b"), F.col("key").alias("kb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.col("s").alias("sb"))
    shared = overlap_pairs(members).join(a.select("stream_id", "a", "ka"), ["stream_id", "a"]).join(b.select("stream_id", "b", "kb"), ["stream_id", "b"]).where("ka <> kb").select("stream_id", "a", "b")
    # two hulls within span segments begin in the same block of that many, or in neighbouring ones
    wide = max(1, span)
    own = a.where("sa").withColumn("g", F.floor(F.col("alo") / wide))
    other = b.where("sb").withColumnRenamed("kb", "ka").withColumn("g", F.explode(F.array(*(F.floor(F.col("blo") / wide) + i for i in (-1, 0, 1)))))
    same = own.join(other, ["stream_id", "ka", "g"]).where("a < b").where(F.greatest("ahi", "bhi") - F.least("alo", "blo") + 1 <= wide).select("stream_id", "a", "b")
    edges = shared.union(same)
    if nearby >= 0:  # hulls dealt to blocks of span segments, widened by the allowed distance
        block = max(1, span)
        deal = lambda df, lo, hi: df.withColumn("g", F.explode(F.sequence(F.floor((F.col(lo) - nearby - 1) / block), F.floor((F.col(hi) + nearby + 1) / block))))
        met = deal(a, "alo", "ahi").join(deal(b, "blo", "bhi"), ["stream_id", "g"]).where("a < b and ka <> kb")
        gap = F.greatest("alo", "blo") - F.least("ahi", "bhi") - 1
        edges = edges.union(met.where((gap >= 0) & (gap <= nearby) & (F.greatest("ahi", "bhi") - F.least("alo", "blo") + 1 <= block)).select("stream_id", "a", "b"))
    return edges.distinct()


def clusters(edges: DataFrame, suspicious: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(stream_id, match_ord, cluster): connected components of the edges and single suspicious matches; the smallest match_ord names a cluster.

    Alternating star steps, so that rounds grow with the logarithm of the longest
    chain; an error is raised if max_rounds do not reach the fixpoint.
    """
    edges = dealt(edges.select("stream_id", "a", "b"))
    labels = components_within(edges, "stream_id", max_rounds).select("stream_id", F.col("node").alias("match_ord"), F.col("component").alias("cluster"))
    ends = edges.select("stream_id", F.explode(F.array("a", "b")).alias("match_ord"))
    every = ends.union(suspicious.select(*MATCH).repartition("stream_id")).distinct()
    return every.join(labels, MATCH, "left").select(*MATCH, F.coalesce("cluster", "match_ord").alias("cluster"))


def containing(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(outer, inner) of distinct keys of which the first contains the second; the empty one is in all.

    They meet by three characters of the second (all, if it has fewer): those that
    the fewest of the first have, so that a common beginning brings no crowd together.
    """
    places = F.sequence(F.lit(1), F.length("key"))
    of_length = lambda n: F.filter(F.transform(places, lambda i: F.substring("key", i, F.lit(n))), lambda g: F.length(g) == n)
    empty = inner.where("key = ''").select(F.col("key").alias("inner")).distinct()  # one row at most
    some = outer.where("key <> ''").select(F.col("key").alias("outer"), F.explode(F.array_distinct(F.concat(of_length(1), of_length(2), of_length(3)))).alias("gram"))
    own = inner.where("key <> ''").select(F.col("key").alias("inner"), F.explode(F.array_distinct(F.when(F.length("key") < 3, F.array("key")).otherwise(of_length(3)))).alias("gram"))
    rare = own.join(some.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    met = some.join(rare.where("r.n > 0").select("inner", F.col("r.gram").alias("gram")), "gram")
    found = met.where(F.contains("outer", "inner")).select("outer", "inner")
    return found.union(outer.select(F.col("key").alias("outer")).crossJoin(F.broadcast(empty)))


def select_best(members: DataFrame, cluster: DataFrame, segments: DataFrame, searched: DataFrame, cap_s: float) -> DataFrame:
    """Greedy choice of matches that share no segment within each cluster, best evidence first: (stream_id, match_ord, cluster, action).

    searched has the column title: texts with search evidence. A fold over the
    cluster's matches in order of evidence carries the segments taken so far.
    """
    keys, known = (df.select(title_key(F.col("title")).alias("key")).distinct() for df in (members, searched))
    seen = few(containing(keys, known).select(F.col("outer").alias("key")).union(containing(known, keys).select("inner")).distinct().withColumn("seen", F.lit(True)))
    h = measures(members, segments).join(cluster, MATCH).withColumn("key", title_key(F.col("title"))).join(seen, "key", "left").drop("key")
    found = F.coalesce("seen", F.lit(False))
    d = F.col("duration_s")
    order = F.row_number().over(Window.partitionBy("stream_id", "cluster").orderBy("match_ord"))
    over = F.when(F.lit(cap_s) > 0, F.least(F.lit(0.0), cap_s - d)).otherwise(0.0)
    rank = F.struct(found.cast("int").alias("found"), (~F.startswith(F.trim("title"), F.lit(UNNAMED))).cast("int").alias("named"), "confidence", (F.lit(cap_s <= 0) | (d <= cap_s)).cast("int").alias("fits"), over.alias("over"), (-order).alias("place"))
    ids = members.groupBy(*MATCH).agg(F.collect_set("idx").alias("ids"))
    rows = h.withColumn("rank", rank).join(ids, MATCH).select("stream_id", "cluster", "match_ord", "ids", *(f"rank.{c}" for c in ("found", "named", "confidence", "fits", "over", "place")))
    # ascending order of what is negated is the order of evidence
    by = [(-F.col(c)).alias(c) for c in ("found", "named", "confidence", "fits", "over", "place")]

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        used: set[int] = set()
        for match_ord, own, *_ in group:
            keep = used.isdisjoint(own)
            if keep:
                used.update(own)
            yield match_ord, "keep" if keep else "discard"

    out = scan(rows.select("stream_id", "cluster", "match_ord", "ids", *by), ["stream_id", "cluster"], ["found", "named", "confidence", "fits", "over", "place"], fold, "match_ord long, action string", dealt=["stream_id"])
    return out.select("stream_id", "match_ord", "cluster", "action").repartition("stream_id")


def best_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """For every match of left the match of right that shares most segments, then the more confident, then the earlier: (stream_id, match_ord, o, shared, o_title, o_confidence)."""
    r = right.select("stream_id", "idx", F.col("match_ord").alias("o"))
    counts = left.select(*MATCH, "idx").join(r, ["stream_id", "idx"]).groupBy(*MATCH, "o").agg(F.count("*").alias("shared"))
    names = heads(right).select("stream_id", F.col("match_ord").alias("o"), F.col("title").alias("o_title"), F.col("confidence").alias("o_confidence"))
    order = Window.partitionBy(*MATCH).orderBy(F.desc("shared"), F.desc("o_confidence"), "o")
    return counts.join(names, ["stream_id", "o"]).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def restore_titles(temporal: DataFrame, source: DataFrame, *, least: float = 0.65) -> DataFrame:
    """Matches of temporal, renamed after their best source where their own title is unknown; sources that share nothing and are confident enough follow.

    Gives (stream_id, origin, match_ord, title, confidence, decision).
    """
    h = heads(temporal).join(best_overlap(temporal, source), MATCH, "left")
    named = lambda c: F.coalesce((F.trim(c) != "") & ~F.startswith(title_key(F.col(c)), F.lit(UNNAMED)), F.lit(False))
    same = title_key(F.col("title")) == title_key(F.col("o_title"))
    decision = (
        F.when(named("title") & named("o_title"), F.when(same, "consistent").otherwise("conflict"))
        .when(named("title"), "temporal_only").when(F.col("o_title").isNull(), "new").when(named("o_title"), "restored").otherwise("unknown_preserved")
    )
    title = F.when(decision == "new", F.lit(ADDED)).when(decision.isin("restored", "conflict", "unknown_preserved"), F.col("o_title")).otherwise(F.col("title"))
    confidence = F.when(decision.isin("temporal_only", "new"), F.col("confidence")).otherwise(F.greatest("confidence", "o_confidence"))
    kept = h.select("stream_id", F.lit("temporal").alias("origin"), "match_ord", title.alias("title"), confidence.alias("confidence"), decision.alias("decision"))
    covered = source.join(temporal.select("stream_id", "idx").distinct(), ["stream_id", "idx"], "left_semi").select(*MATCH).distinct()
    rest = heads(source).join(covered, MATCH, "left_anti").where(F.col("confidence") >= least)
    return kept.union(rest.select("stream_id", F.lit("source"), "match_ord", "title", "confidence", F.lit("appended")))


def split_at_sources(temporal: DataFrame, source: DataFrame) -> DataFrame:
    """Parts (stream_id, match_ord, part, lo, hi) of matches, cut half-way between the sources they swallowed.

    A source supports a match that holds half of its segments. A match is cut
    if it has two supporters at least, of two titles at least, whose hulls lie apart.
    """
    t = heads(temporal).select(*MATCH, "lo", "hi")
    s = heads(source).select("stream_id", F.col("match_ord").alias("o"), title_key(F.col("title")).alias("key"), F.col("lo").alias("slo"), F.col("hi").alias("shi"), F.col("n").alias("sn"))
    r = source.select("stream_id", "idx", F.col("match_ord").alias("o"))
    counts = temporal.select(*MATCH, "idx").distinct().join(r, ["stream_id", "idx"]).groupBy(*MATCH, "o").agg(F.count_distinct("idx").alias("shared"))
    support = counts.join(s, ["stream_id", "o"]).where(F.col("shared") * 2 >= F.col("sn"))
    order = Window.partitionBy(*MATCH).orderBy("slo", "o")
    support = support.withColumn("next", F.lead("slo").over(order)).withColumn("k", F.row_number().over(order))
    rule = support.groupBy(*MATCH).agg(F.count("*").alias("c"), F.count_distinct("key").alias("titles"), F.bool_and(F.col("next").isNull() | (F.col("shi") < F.col("next"))).alias("clear"))
    cut = support.join(rule.where("c >= 2 and titles >= 2 and clear"), MATCH)
    parts = cut.withColumn("end", F.floor((F.col("shi") + F.col("next")) / 2).cast("long")).withColumn("begin", F.lag("end").over(order) + 1).join(t, MATCH)
    parts = parts.select(*MATCH, F.col("k").cast("long").alias("part"), F.greatest("lo", F.coalesce("begin", "lo")).alias("lo"), F.least("hi", F.coalesce("end", "hi")).alias("hi")).where("lo <= hi")
    whole = t.join(cut.select(*MATCH).distinct(), MATCH, "left_anti").select(*MATCH, F.lit(1).cast("long").alias("part"), "lo", "hi")
    return parts.union(whole)


def evaluate(members: DataFrame, truth: DataFrame, *, truth_confidence: float = 0.6, hit: float = 0.5) -> DataFrame:
    """By stream, against the confident matches of truth: matches, pairs that overlap, recall, agreement and coverage counts."""
    anchors = truth.where(F.col("confidence") >= truth_confidence)
    size = heads(anchors).select(*MATCH, "n", "title")
    best = best_overlap(anchors, members)
    found = size.join(best, MATCH, "left").groupBy("stream_id").agg(
        F.count("*").alias("anchors"), F.count_if(F.coalesce(F.col("shared"), F.lit(0)) >= hit * F.col("n")).alias("hits"),
        F.count_if((F.coalesce(F.col("shared"), F.lit(0)) >= hit * F.col("n")) & (title_key(F.col("title")) == title_key(F.col("o_title")))).alias("agreed"),
    )
    pairs = overlap_pairs(members).groupBy("stream_id").agg(F.count("*").alias("overlap_pairs"))
    from spanloom.operators.intervals import cover_compare

    cover = cover_compare(members, anchors).withColumnRenamed("both", "true_segments").withColumnRenamed("only_left", "extra_segments").withColumnRenamed("only_right", "missed_segments")
    counts = heads(members).groupBy("stream_id").agg(F.count("*").alias("matches"))
    out = counts.join(found, "stream_id", "left").join(pairs, "stream_id", "left").join(cover, "stream_id", "left")
    zero = {c: 0 for c in ("anchors", "hits", "agreed", "overlap_pairs", "true_segments", "extra_segments", "missed_segments")}
    out = out.fillna(zero)
    return out.withColumn("precision", F.try_divide(F.col("true_segments"), F.col("true_segments") + F.col("extra_segments"))).withColumn("recall", F.try_divide(F.col("true_segments"), F.col("true_segments") + F.col("missed_segments")))
