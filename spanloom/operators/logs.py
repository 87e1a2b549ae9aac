"""Evidence in logged tool calls and earlier summaries, read as VARIANT documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the echo of a query in a logged preview that is no JSON.
ECHO = r"""(?i)['"]query['"]\s*:\s*['"][^'"]*['"]\s*,?"""


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, VOID (a JSON null) or another type's name; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _part(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def _truthy(value: Column) -> Column:
    """Whether a JSON value is there and not null, false, zero, or empty."""
    text = F.to_json(value)
    return F.coalesce(value.isNotNull() & ~text.isin("null", "false", '""', "[]", "{}", "0", "0.0", "-0.0"), F.lit(False))


def summaries(documents: DataFrame, text: str = "raw") -> DataFrame:
    """documents with summary (a VARIANT) and status: valid, invalid_json, not_an_object, empty, error, or incomplete.

    A valid summary tells no error and has a list level_1 or an object overall.
    The document of any other is null.
    """
    doc = F.try_parse_json(F.col(text))
    level, overall = _kind(_part(F.col("__doc"), "$.level_1")), _kind(_part(F.col("__doc"), "$.overall"))
    status = (
        F.when(F.col("__doc").isNull(), "invalid_json").when(_kind(F.col("__doc")) != "OBJECT", "not_an_object").when(F.to_json("__doc") == "{}", "empty")
        .when(_truthy(_part(F.col("__doc"), "$.error")), "error").when((F.coalesce(level, F.lit("")) != "ARRAY") & (F.coalesce(overall, F.lit("")) != "OBJECT"), "incomplete").otherwise("valid")
    )
    rows = documents.withColumn("__doc", doc).withColumn("status", status)
    return rows.withColumn("summary", F.when(F.col("status") == "valid", F.col("__doc"))).drop("__doc")


def tool_evidence(logs: DataFrame, keys: list[str], text: str = "raw") -> DataFrame:
    """(keys, call, evidence) of the tool calls that logs hold: what each one's results and hints say, never its query.

    A log is a JSON object with tool_calls_log. A call's result_summary counts if
    it is an object, else its result_preview: its results and hints if it is
    JSON, else its text without the query it repeats. A log that cannot be read
    has no calls; a call without either has empty evidence.
    """
    doc = F.try_parse_json(F.col(text))
    calls = logs.select(*keys, F.posexplode(F.try_variant_get(doc, "$.tool_calls_log", "array<variant>")).alias("call", "__c"))
    said = lambda v: F.to_json(F.struct(_part(v, "$.results").alias("results"), _part(v, "$.lyrics_hints").alias("lyrics_hints")))
    summary, preview = _part(F.col("__c"), "$.result_summary"), F.coalesce(F.try_variant_get("__c", "$.result_preview", "string"), F.lit(""))
    rows = calls.withColumn("__s", summary).withColumn("__t", preview).withColumn("__p", F.try_parse_json("__t"))
    evidence = F.when(_kind(F.col("__s")) == "OBJECT", said(F.col("__s"))).when(_kind(F.col("__p")) == "OBJECT", said(F.col("__p"))).otherwise(F.regexp_replace("__t", ECHO, ""))
    return rows.select(*keys, F.col("call").cast("long").alias("call"), evidence.alias("evidence"))


def supported_titles(matches: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, title, supported) of named matches (keys, title, artist): whether one call's evidence holds the title, and the artist if there is one."""
    from spanloom.functions.scalars import title_key, unknown_title

    named = matches.where(~unknown_title(F.col("title"))).select(*keys, "title", title_key(F.col("title")).alias("__t"), F.lower(F.trim(F.coalesce("artist", F.lit("")))).alias("__a")).distinct()
    told = evidence.select(*keys, F.lower("evidence").alias("__e"))
    hit = F.contains("__e", "__t") & ((F.col("__a") == "") | F.contains("__e", "__a"))
    found = named.join(told, keys).where(hit).select(*keys, "title").distinct().withColumn("supported", F.lit(True))
    return named.select(*keys, "title").distinct().join(found, [*keys, "title"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))
