"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree of domain, language and source. A node shares
its budget among its children by weight; a child that can give less than its
share gives all it can, and the rest goes to its siblings. A node never gets more
than its leaves can give together, so a shortage reaches an ancestor's other
children only once the siblings are exhausted. A leaf's budget is spent on seeded
epochs: whole epochs first, then the longest prefix of the next one that fits.

Budgets are windows over the small tables of nodes. Inside a leaf, documents fall
into 256 buckets by the hash that orders them; the sums of buckets show in which
one the budget runs out, that one is divided into 256 again, and only the bucket
of those in which it runs out (1/65,536 of the leaf) is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.shared import cut, table

TREE = ("__domain", "__lang", "__source")
#: Weights by level and value; all others weigh 10.
WEIGHTS = {"__domain": {"d0": 30, "d1": 20}, "__lang": {"en": 40, "de": 20, "fr": 20}, "__source": {"src0": 15}}
SHARE, SEED, EPOCHS = 0.6, 17, 2
#: Leaf tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000
EDGE_DIGITS = 4


def n_tokens(text: Column) -> Column:
    """Tokens for budgets: runs of characters other than blanks and line feeds; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^ \n]+"), F.lit(0))), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """d0 for the sources ending in the numbers 0-4, d1 for 5-9, and so on; d-1 for others."""
    number = F.substring(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1), 1, 9).try_cast("int")
    return F.concat(F.lit("d"), F.coalesce(F.floor(number / 5).cast("string"), F.lit("-1")))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(10)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
    return out.cast("double")


def budgets(leaves: DataFrame, *, share: float, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (tree columns and has, the tokens of one epoch) with budget, the tokens to spend."""
    given = leaves.agg(F.floor(F.coalesce(F.sum("has"), F.lit(0)) * F.lit(share)).cast("long").alias("amount"))
    for k, level in enumerate(TREE):
        above = list(TREE[:k])
        nodes = leaves.groupBy(*TREE[: k + 1]).agg((F.sum("has") * epochs).alias("can")).withColumn("w", _weight(level, weights))
        nodes = nodes.join(given, above) if above else nodes.join(F.broadcast(given))  # the root's budget: one row
        order = Window.partitionBy(*above, "amount").orderBy(F.col("can") / F.col("w"), level)
        before = F.coalesce(F.sum("can").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nodes = nodes.withColumn("left", (F.col("amount") - before).cast("double")).withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        nodes = nodes.withColumn("full", F.col("can").cast("double") * F.col("rest") <= F.col("left") * F.col("w"))
        # Children come by need for their weight: the full ones first, and all others share what these leave.
        whole = Window.partitionBy(*above, "amount")
        open_ = F.min(F.when(~F.col("full"), F.struct((F.col("can") / F.col("w")).alias("r"), F.col(level).alias("v"), "left", "rest"))).over(whole)
        nodes = nodes.withColumn("open", open_)
        part = F.floor(F.col("open.left") * F.col("w") / F.col("open.rest")).cast("long")
        given = nodes.select(*TREE[: k + 1], F.when(F.col("full"), F.col("can")).otherwise(part).alias("amount"))
    return leaves.join(given.withColumnRenamed("amount", "budget"), list(TREE))


def mix(docs: DataFrame, *, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, dict[str, int]] = WEIGHTS, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The selected rows of docs, all columns, with the tree columns, __n (tokens) and __epoch added.

    share of the table's tokens is spent, at most ``epochs`` times over each
    leaf. Null languages and sources form the leaf value 'none'; null texts have
    no tokens and are taken with the prefix they fall into. Rows are put in
    order by the hash of seed, epoch and key, repeated keys then by text. An
    empty table, or one without tokens, gives an empty result. The names
    __domain, __lang, __source, __n and __epoch are refused as columns of docs.
    """
    if taken := {*TREE, "__n", "__epoch", "__u", "__b", "__edge", "__before", "__whole", "__rest", "__to"} & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(taken)}")
    leaf = docs.withColumn("__domain", domain_of(F.col(source))).withColumn("__lang", F.coalesce(F.col(lang), F.lit("none"))).withColumn("__source", F.coalesce(F.col(source), F.lit("none")))

    def hashed(epoch: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))

    sized = leaf.select(*TREE, F.col(key), n_tokens(F.col(text)).alias("__n"))
    spent = budgets(sized.groupBy(*TREE).agg(F.sum("__n").alias("has")), share=share, epochs=epochs, weights=weights)
    whole = F.floor(F.col("budget") / F.col("has")).cast("int")
    spent = cut(spent.where("has > 0").select(*TREE, whole.alias("__whole"), (F.col("budget") - whole * F.col("has")).alias("__rest")))
    small = spent.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda df: df

    # The prefix of the hash at which the budget runs out, two digits at a time, each time among the rows of the last one.
    plan = spent.select("*", F.lit("").alias("__edge"), F.lit(0).cast("long").alias("__before"))
    for digits in range(2, EDGE_DIGITS + 1, 2):
        inside = sized.join(hint(plan), list(TREE)).withColumn("__u", hashed(F.col("__whole"))).where(F.col("__u").startswith(F.col("__edge")))
        sums = inside.withColumn("b", F.substring("__u", 1, digits)).groupBy(*TREE, "__rest", "__before", "b").agg(F.sum("__n").alias("n"))
        running = sums.withColumn("to", F.col("__before") + F.sum("n").over(Window.partitionBy(*TREE).orderBy("b"))).where(F.col("to") > F.col("__rest"))
        edge = running.groupBy(*TREE).agg(F.min(F.struct("b", (F.col("to") - F.col("n")).alias("before"))).alias("e"))
        plan = cut(spent.join(edge, list(TREE), "left").select(*TREE, "__whole", "__rest", F.coalesce("e.b", F.lit("~")).alias("__edge"), F.coalesce("e.before", F.lit(0)).alias("__before")))

    rows = leaf.join(hint(plan), list(TREE)).withColumn("__u", hashed(F.col("__whole"))).withColumn("__b", F.substring("__u", 1, EDGE_DIGITS))
    names = [*docs.columns, *TREE]
    again = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__whole"))))
    sure = again.where((F.col("__epoch") < F.col("__whole")) | (F.col("__b") < F.col("__edge"))).select(*names, n_tokens(F.col(text)).alias("__n"), "__epoch")
    last = rows.where(F.col("__b") == F.col("__edge")).withColumn("__n", n_tokens(F.col(text)))
    order = Window.partitionBy(*TREE).orderBy("__u", text).rowsBetween(Window.unboundedPreceding, 0)
    fits = last.withColumn("__to", F.col("__before") + F.sum("__n").over(order)).where(F.col("__to") <= F.col("__rest"))
    return sure.union(fits.select(*names, "__n", F.col("__whole").alias("__epoch")))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__n").alias("n_tokens"), F.col("__epoch").cast("long").alias("epoch"))


def _level_sql(k: int, weight: str) -> str:
    keys = ["domain", "lang", "source"][: k + 1]
    above, level = keys[:-1], keys[-1]
    part = ", ".join([*above, "amount"])
    source = f"given{k - 1} USING ({', '.join(above)})" if above else "given_root ON true"
    return f"""
node{k} AS (SELECT {', '.join(keys)}, amount, can, w FROM (SELECT {', '.join(keys)}, sum(has)::BIGINT * {EPOCHS} AS can, ({weight})::DOUBLE AS w FROM leaves GROUP BY ALL) JOIN {source}),
left{k} AS (SELECT *, (amount - coalesce(sum(can) OVER (PARTITION BY {part} ORDER BY can / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_,
  sum(w) OVER (PARTITION BY {part} ORDER BY can / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM node{k}),
full{k} AS (SELECT *, can::DOUBLE * rest <= left_ * w AS full_ FROM left{k}),
open{k} AS (SELECT *, min(CASE WHEN NOT full_ THEN row(can / w, {level}, left_, rest) END) OVER (PARTITION BY {part}) AS o FROM full{k}),
given{k} AS (SELECT {', '.join(keys)}, CASE WHEN full_ THEN can ELSE floor(o[3] * w / o[4])::BIGINT END AS amount FROM open{k})"""


def _case(level: str, name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{v}' THEN {w}" for v, w in WEIGHTS[level].items()) + " ELSE 10 END"


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, text,
  'd' || coalesce(floor(try_cast(substr(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 1, 9) AS INTEGER) / 5)::INTEGER::VARCHAR, '-1') AS domain,
  coalesce(len(regexp_extract_all(text, '[^ \\n]+')), 0)::BIGINT AS n FROM documents),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS has FROM docs GROUP BY ALL),
given_root AS (SELECT floor(coalesce(sum(has), 0) * {SHARE}::DOUBLE)::BIGINT AS amount FROM leaves),
{','.join(_level_sql(k, _case(level, level[2:])) for k, level in enumerate(TREE))},
spent AS (SELECT domain, lang, source, floor(amount / has)::BIGINT AS whole, amount - floor(amount / has)::BIGINT * has AS rest FROM leaves JOIN given2 USING (domain, lang, source) WHERE has > 0),
again AS (SELECT docs.*, whole, rest, unnest(range(0, whole + 1)) AS epoch FROM docs JOIN spent USING (domain, lang, source)),
running AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, 'null')), text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM again)
SELECT doc_id, domain, lang, source, n AS n_tokens, epoch::BIGINT AS epoch FROM running WHERE epoch < whole OR upto <= rest
"""
