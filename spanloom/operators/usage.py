"""Token usage, prices, cost estimates and strategy choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.scalars import price, tokens_of

#: Expected completion tokens of each kind of call.
COMPLETION = {"main": 720, "review": 420, "overlong": 360, "missed_full": 1100, "missed_window": 360}


def _sums() -> list[Column]:
    return [F.count("*").alias("calls"), F.sum("hit").alias("hit"), F.sum("miss").alias("miss"), F.sum("completion").alias("completion")]


def _ratio() -> Column:
    return F.try_divide(F.col("hit"), F.col("hit") + F.col("miss")).alias("hit_ratio")


def totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens, cache-hit ratio (null without input) and cost by keys."""
    rows = usage.groupBy(*keys).agg(*_sums())
    return rows.select(*keys, "calls", "hit", "miss", "completion", _ratio(), price(F.col("hit"), F.col("miss"), F.col("completion")).alias("cost_usd"))


def report(usage: DataFrame) -> DataFrame:
    """Totals by phase, by content type and altogether, in one pass over the input."""
    rows = usage.groupingSets([[usage.phase], [usage.content_type], []], usage.phase, usage.content_type).agg(*_sums())
    return rows.select("phase", "content_type", "calls", "hit", "miss", "completion", _ratio())


def profile_compare(usage: DataFrame, profile: str) -> DataFrame:
    """Totals by profile with cost against the cheapest; nothing with fewer than two profiles."""
    rows = totals(usage, [profile])
    all_ = Window.partitionBy(F.lit(0))  # one row for each profile
    rows = rows.withColumn("n", F.count("*").over(all_)).where("n >= 2")
    return rows.withColumn("against_best", F.col("cost_usd") / F.min("cost_usd").over(all_)).drop("n")


def calibration(estimate: DataFrame, actual: DataFrame, *, most: float = 0.15) -> DataFrame:
    """Estimated against actual cost by phase; valid within ``most`` of the actual one."""
    both = estimate.select("phase", F.col("cost_usd").alias("estimated")).join(actual.select("phase", F.col("cost_usd").alias("actual")), "phase", "full")
    off = F.try_divide(F.abs(F.coalesce("estimated", F.lit(0.0)) - F.coalesce("actual", F.lit(0.0))), F.col("actual"))
    return both.withColumn("error", off).withColumn("valid", F.coalesce(off <= most, F.lit(False)))


def stream_features(segments: DataFrame, members: DataFrame, targets: DataFrame, clusters: DataFrame) -> DataFrame:
    """By stream: segments, characters, seconds, matches, targets and clusters."""
    base = segments.groupBy("stream_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), (F.max("end_s") - F.min("start_s")).alias("seconds"))
    out = base
    for df, c, name in ((members, F.count_distinct("match_ord"), "matches"), (targets, F.count("*"), "targets"), (clusters, F.count_distinct("cluster"), "clusters")):
        out = out.join(df.groupBy("stream_id").agg(c.alias(name)), "stream_id", "left")
    return out.fillna(0, ["matches", "targets", "clusters"])


def estimates(features: DataFrame, *, batch: int = 20, template_chars: int = 400) -> DataFrame:
    """Cost of the calls of each stage, from a stream's features: the transcript is cached after the first call."""
    text = tokens_of(F.col("chars"))
    template = tokens_of(F.lit(template_chars))
    calls = F.ceil(F.col("segments") / batch)
    one = lambda n, kind: price(F.lit(0), n * (text / calls + template), n * COMPLETION[kind])
    whole = lambda n, kind: F.when(n > 0, price(text * n, template * n, n * COMPLETION[kind])).otherwise(0.0)
    return features.select(
        "*", price(F.lit(0), text + template * calls, calls * COMPLETION["main"]).alias("main_usd"), one(F.col("clusters"), "review").alias("review_local_usd"), whole(F.least(F.col("clusters"), F.lit(1)), "review").alias("review_full_usd"),
        one(F.col("targets"), "missed_window").alias("missed_windowed_usd"), whole(F.least(F.col("targets"), F.lit(1)), "missed_full").alias("missed_full_usd"),
    )


def choose(cheap: Column, other: Column, cheap_name: str, safe_name: str, margin: float) -> Column:
    """cheap_name, or safe_name if the costs lie within margin of the larger."""
    return F.when(F.abs(cheap - other) / F.greatest(cheap, other, F.lit(1e-9)) < margin, safe_name).otherwise(cheap_name)


def heuristic(features: DataFrame, *, most_segments: int = 3500, least_targets: int = 19) -> DataFrame:
    """Scope and strategy by counts alone."""
    big = F.col("segments") > most_segments
    return features.withColumn("scope", F.when(big | (F.col("clusters") <= 3), "local").otherwise("full")).withColumn("strategy", F.when(big | (F.col("targets") < least_targets), "windowed").otherwise("full"))


def joint_choice(costs: DataFrame, *, margin: float = 0.1, most_segments: int = 3500) -> DataFrame:
    """The cheapest of the scope and strategy pairs a stream may take; within margin of the first pair, the first one."""
    options = F.array(*(
        F.struct(F.lit(k).alias("k"), F.lit(s).alias("scope"), F.lit(m).alias("strategy"), (F.col("main_usd") + F.col(f"review_{s}_usd") + F.col(f"missed_{m}_usd")).alias("usd"))
        for k, (s, m) in enumerate((s, m) for s in ("local", "full") for m in ("windowed", "full"))
    ))
    open_ = F.filter(options, lambda o: (F.col("segments") <= most_segments) | ((o["scope"] != "full") & (o["strategy"] != "full")))
    best = F.array_min(F.transform(open_, lambda o: F.struct(o["usd"].alias("usd"), o["k"].alias("k"), o["scope"].alias("scope"), o["strategy"].alias("strategy"))))
    first = F.get(open_, 0)
    rows = costs.withColumn("best", best).withColumn("first", first)
    near = F.abs(F.col("best.usd") - F.col("first.usd")) / F.greatest(F.col("best.usd"), F.col("first.usd"), F.lit(1e-9)) < margin
    pick = lambda c: F.when(near, F.col(f"first.{c}")).otherwise(F.col(f"best.{c}")).alias(c)
    return rows.select("stream_id", pick("scope"), pick("strategy"), pick("usd"))


def storm(candidates: DataFrame, segments: DataFrame, *, least: int = 64, per_hour: float = 40.0, share: float = 0.7) -> DataFrame:
    """Streams with more candidates than max(least, per_hour an hour) of which at least share have two segments at most."""
    hours = segments.groupBy("stream_id").agg(F.greatest(F.lit(1 / 60), (F.max(F.struct("idx", "end_s"))["end_s"] - F.min(F.struct("idx", "start_s"))["start_s"]) / 3600).alias("hours"))
    sizes = candidates.groupBy("stream_id", "match_ord").agg(F.count("*").alias("n")).groupBy("stream_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("n") <= 2).alias("short"))
    rows = sizes.join(hours, "stream_id")
    limit = F.greatest(F.lit(least), F.ceil(F.col("hours") * per_hour))
    return rows.select("stream_id", "candidates", "short", ((F.col("candidates") > limit) & (F.col("short") / F.col("candidates") >= share)).alias("storm"))
