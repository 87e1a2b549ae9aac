"""Texts that an annotator returned: parsing, recovery of cut-off arrays, continuation.

A text may be plain JSON, fenced, surrounded by prose, or cut off in the middle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ITEM = "struct<title:string,segment_indices:array<string>,confidence:string>"


def unfenced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def span(text: Column) -> Column:
    """From the earliest of '[' and '{' to the last of its closing kind."""
    return F.nullif(F.regexp_extract(text, r"(?s)^[^\[{]*(\[.*\]|\{.*\})", 1), F.lit(""))


def parsed(responses: DataFrame, text: str = "raw") -> DataFrame:
    """responses with json (VARIANT of the whole text or of its span, or null) and status: ok, empty or failed."""
    rows = responses.withColumn("__plain", unfenced(F.col(text))).withColumn("__span", span(F.col("__plain")))
    rows = rows.withColumn("json", F.coalesce(F.try_parse_json("__plain"), F.try_parse_json("__span"))).drop("__plain", "__span")
    status = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.col("json").isNull(), "failed").otherwise("ok")
    return rows.withColumn("status", status)


def objects_of(raw: str) -> list[str]:
    """The complete top-level objects of a text's first array, as JSON; what is cut off drops out."""
    start = raw.find("[")
    out, at, decoder = [], start + 1, json.JSONDecoder()
    while start >= 0:
        while at < len(raw) and raw[at] in " \t\r\n,":
            at += 1
        if at >= len(raw) or raw[at] != "{":
            break
        try:
            value, at = decoder.raw_decode(raw, at)
        except ValueError:
            break
        out.append(json.dumps(value, ensure_ascii=False))
    return out


def recovered(failed: DataFrame, keys: list[str], text: str = "raw") -> DataFrame:
    """Items (keys, pos, item as JSON text) of texts that could not be parsed."""
    schema = failed.select(*keys).schema.add("pos", "long").add("item", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*row[:-1], k, x) for row in batch.itertuples(index=False) for k, x in enumerate(objects_of(row[-1] or ""))]
            yield pd.DataFrame(found, columns=[*keys, "pos", "item"])

    return failed.select(*keys, text).mapInPandas(run, schema)


def items(responses: DataFrame, keys: list[str], text: str = "raw") -> DataFrame:
    """One row for each object of each response: (keys, pos, title, indices, confidence, recovered).

    A response that is no array has none. Elements that are no objects drop out,
    as do items without a title or an index.
    """
    rows = parsed(responses, text)
    good = rows.select(*keys, F.try_variant_get("json", "$", "array<variant>").alias("a"))
    good = good.select(*keys, F.posexplode_outer("a").alias("pos", "v"))
    good = good.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))).select(*keys, F.col("pos").cast("long").alias("pos"), F.to_json("v").alias("item"), F.lit(False).alias("recovered"))
    saved = recovered(rows.where("status = 'failed'"), keys, text).select(*keys, "pos", "item", F.lit(True).alias("recovered"))
    every = good.union(saved).withColumn("x", F.from_json("item", ITEM))
    from spanloom.functions.scalars import confidence, index_list

    out = every.select(*keys, "pos", F.trim("x.title").alias("title"), index_list(F.coalesce("x.segment_indices", F.array().cast("array<string>"))).alias("indices"), confidence(F.coalesce("x.confidence", F.lit("0.5"))).alias("confidence"), "recovered")
    return out.where((F.col("title") != "") & (F.size("indices") > 0))


def continued(rounds: DataFrame) -> DataFrame:
    """Items of several rounds (stream_id, round, pos, title, indices) as one list: the first of equal ones, in order."""
    order = Window.partitionBy("stream_id", "title", "indices").orderBy("round", "pos")
    once = rounds.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    return once.withColumn("pos", (F.row_number().over(Window.partitionBy("stream_id").orderBy("round", "pos")) - 1).cast("long"))


def complete(rounds: DataFrame) -> DataFrame:
    """(stream_id, complete) of (stream_id, round, valid, truncated): whether the last round is valid and not cut off."""
    last = F.max(F.struct("round", (F.col("valid") & ~F.col("truncated")).alias("ok")))
    return rounds.groupBy("stream_id").agg(last["ok"].alias("complete"))


def reusable(logs: DataFrame, requests: DataFrame) -> DataFrame:
    """Logged responses that answer a request as it is now: same fingerprint, parsed, no error, repair or cut-off."""
    good = logs.where("error is null and valid and not repaired and not truncated")
    return requests.join(good.select("fingerprint", "raw"), "fingerprint")


def failures(logs: DataFrame) -> DataFrame:
    """By stream, the kinds of structural failure its logs show, and whether all and any were valid."""
    kinds = F.array_compact(F.array(F.when(F.col("error").isNotNull(), F.lit("error")), F.when(~F.col("valid"), F.lit("invalid_json")), F.when(F.col("repaired"), F.lit("repaired")), F.when(F.col("truncated"), F.lit("truncated"))))
    return logs.withColumn("kinds", kinds).groupBy("stream_id").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))), ",").alias("failures"), F.bool_and("valid").alias("all_valid"), F.bool_or("valid").alias("any_valid"))
