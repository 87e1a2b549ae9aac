"""Names of clips: dictionary look-up of streamers, search evidence of titles, rename plans."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType
from pyspark.sql.window import Window

from spanloom.functions.scalars import clip_stem, date_in, described_parts, garbled, overlap_coefficient, page_title, text_tokens, unknown_prefix

#: Fixed value: characters that matching ignores.
IGNORED = r"[\s\-_·・，。、！!？?（）()\[\]【】「」『』《》\"'“”‘’:：;；]+"
LEAST_LIKENESS = 0.8


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility-composed, case-folded form of a text, for which Spark has no function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def match_text(text: Column) -> Column:
    """The folded text without blanks and punctuation."""
    return F.regexp_replace(F.trim(folded(text)), IGNORED, "")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def similarity(a: Column, b: Column, *, ratio: bool = True) -> Column:
    """1 for equal texts, at least .92 where one holds the other and is not much shorter, else the matching ratio (0 if ratio is off)."""
    inside = (F.contains(a, b) | F.contains(b, a)) & (F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)) >= 0.45)
    rest = sequence_ratio(a, b) if ratio else F.lit(0.0)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, F.greatest(F.lit(0.92), rest)).otherwise(rest)


def _all_grams(text: Column) -> Column:
    """Pairs of characters, as often as they occur, and single ones of texts of up to three."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) <= 3, F.concat(pairs, F.split(text, ""))).otherwise(pairs)


def _grams(text: Column) -> Column:
    """The same, each once. Texts as like as LEAST_LIKENESS, or of which one holds the other and is not much shorter, share one."""
    return F.array_distinct(_all_grams(text))


def _may_be_like(a: Column, b: Column) -> Column:
    """False only for texts whose ratio is below LEAST_LIKENESS by the characters that one lacks altogether, and neither of which holds the other."""
    shared = F.least(F.length(a) - F.length(F.call_function("translate", a, b, F.lit(""))), F.length(b) - F.length(F.call_function("translate", b, a, F.lit(""))))
    return (2.0 * shared / (F.length(a) + F.length(b)) >= LEAST_LIKENESS) | F.contains(a, b) | F.contains(b, a)


def resolve_streamers(paths: DataFrame, dictionary: DataFrame, *, threshold: float = LEAST_LIKENESS, ratio: bool = True, fallback: str = "unknown") -> DataFrame:
    """(key, streamer, date, score) of paths (key, path, texts): the alias most like any of its texts.

    Ties go to the first entry, alias and text. Each distinct text is scored
    once with the aliases (entry_ord, streamer, alias_ord, alias) that share a
    pair of characters with it, which no alias of likeness LEAST_LIKENESS lacks;
    so a score below that may be that of a less like alias, or 0.
    """
    if threshold < LEAST_LIKENESS:
        raise ValueError(f"aliases less like than {LEAST_LIKENESS} may not be found")
    texts = paths.select("key", F.posexplode("texts").alias("text_ord", "text"))
    forms = texts.select("text").distinct().withColumn("t", match_text(F.col("text")))
    names = dictionary.select("alias").distinct().withColumn("a", match_text(F.col("alias")))
    # A text of n characters and an alias of likeness LEAST_LIKENESS, or of which one holds the other, share n / 3 - 1 of the
    # text's n - 1 pairs at least, so one of any n - that many; those that the fewest aliases hold are looked up.
    some = names.select("a").where("a <> ''").distinct().select("a", F.explode(_grams(F.col("a"))).alias("gram")).where("gram <> ''")
    held = F.coalesce("n", F.lit(0))
    asked = forms.select("t").where("t <> ''").distinct().select("t", F.explode(_all_grams(F.col("t"))).alias("gram")).where("gram <> ''")
    asked = asked.join(some.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy(held, "gram")))
    few = F.length("t") - F.greatest(F.lit(1), F.ceil(F.length("t") / 3.0 - 1.000001))
    asked = asked.where((F.length("t") <= 3) | (F.col("k") <= few)).where("n > 0").select("t", "gram").distinct()
    met = asked.join(some, "gram").select("t", "a").where(_may_be_like(F.col("a"), F.col("t"))).distinct()
    scores = met.withColumn("score", similarity(F.col("a"), F.col("t"), ratio=ratio))
    entries = dictionary.join(names, "alias").select("a", "entry_ord", "alias_ord", "streamer")
    order = F.struct("score", (-F.col("entry_ord")).alias("e"), (-F.col("alias_ord")).alias("l"), "streamer")
    best_of = scores.join(entries, "a").groupBy("t").agg(F.max(order).alias("s"))
    scored = texts.join(forms, "text").join(best_of, "t").select("key", F.struct("s.score", "s.e", "s.l", (-F.col("text_ord")).alias("o"), "s.streamer").alias("b"))
    best = scored.groupBy("key").agg(F.max("b").alias("b"))
    good = F.col("b.score") >= threshold
    dates = paths.select("key", F.get(F.filter(F.transform("texts", date_in), lambda x: x.isNotNull()), 0).alias("date"))
    return dates.join(best, "key", "left").select("key", F.when(good, F.col("b.streamer")).otherwise(fallback).alias("streamer"), "date", F.coalesce("b.score", F.lit(0.0)).alias("score"))


def query_texts(matches: DataFrame, members: DataFrame, segments: DataFrame) -> DataFrame:
    """(stream_id, match_ord, query): what to search a match by.

    matches has (stream_id, match_ord, snippet, description). The snippet, or else
    the description without its marks, if it has five characters at least; else the
    five middle ones of the match's texts of more than two characters. The last two
    are cut to 100 characters; a match without any has an empty query.
    """
    key = ["stream_id", "match_ord"]
    text = F.trim("text")
    rows = members.select(*key, "idx").distinct().join(segments.select("stream_id", "idx", text.alias("text")), ["stream_id", "idx"]).where(F.length("text") > 2)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("idx")) - 1
    middle = F.floor(F.count("*").over(Window.partitionBy(*key)) / 2)
    near = rows.withColumn("off", place - middle).where("off between -2 and 2").groupBy(*key)
    said = near.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "text"))), lambda x: x["text"]), " ").alias("said"))
    told = F.when(F.length("description") >= 5, described_parts(F.col("description"))["description"])
    query = F.when(F.length("snippet") >= 5, F.col("snippet")).otherwise(F.left(F.coalesce(told, "said", F.lit("")), F.lit(100)))
    return matches.join(said, key, "left").select(*key, query.alias("query"))


def search_evidence(queries: DataFrame, results: DataFrame, *, least: float = 0.15, top: int = 3) -> DataFrame:
    """The first of a match's top results whose snippet is like enough to its query: (key, rank, title, likeness); no row where none is.

    queries has (key, query), results (key, rank, title, snippet).
    """
    rows = results.where(F.col("rank") <= top).join(queries, "key")
    like = overlap_coefficient(text_tokens(F.col("query")), text_tokens(F.col("snippet")))
    first = Window.partitionBy("key").orderBy("rank")
    return rows.withColumn("likeness", like).where(F.col("likeness") >= least).withColumn("k", F.row_number().over(first)).where("k = 1").select("key", "rank", "title", "likeness")


def result_items(results: DataFrame, top: int = 3) -> DataFrame:
    """(query, rank, title, artist, texts) of search results that have a title left when it is cleaned.

    results has (query, rank, title, artist, snippet, hints), hints being the
    query's own and repeated on each of its rows; they count for the first item
    that stays. texts are what may show that an item is right.
    """
    rows = results.where(F.col("rank") <= top).withColumn("title", page_title(F.trim("title"))).where(F.length("title") >= 2)
    first = F.row_number().over(Window.partitionBy("query").orderBy("rank")) == 1
    hints = F.filter(F.transform(F.coalesce("hints", F.array().cast("array<string>")), lambda h: F.trim(h)), lambda h: h != "")
    own = F.filter(F.array(F.trim(F.coalesce("snippet", F.lit("")))), lambda x: x != "")
    texts = F.when(F.col("first"), F.concat(own, hints)).otherwise(own)
    return rows.withColumn("first", first).select("query", "rank", "title", F.nullif(F.trim("artist"), F.lit("")).alias("artist"), texts.alias("texts"))


def search_verification(matches: DataFrame, members: DataFrame, segments: DataFrame, results: DataFrame, *, most: int = 25, unknown_only: bool = True, least: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(matches, audit): matches named after the first of their search results that their own texts support.

    matches has (stream_id, match_ord, title, artist, tags, snippet, description);
    those without a name (all, unless unknown_only), with a query of five
    characters at least, are looked up in order, ``most`` of a stream. audit has a
    row for each look-up: (stream_id, match_ord, query, old_title, candidates,
    best_title, best_artist, score, accepted, reason).
    """
    key = ["stream_id", "match_ord"]
    asked = query_texts(matches, members, segments).where(F.length("query") >= 5).join(matches.select(*key, F.col("title").alias("old_title")), key)
    if unknown_only:
        asked = asked.where(unknown_prefix(F.col("old_title")))
    asked = asked.withColumn("k", F.row_number().over(Window.partitionBy("stream_id").orderBy("match_ord"))).where(F.col("k") <= most)
    asked = asked.select(*key, "old_title", F.col("query").alias("text"), F.left("query", F.lit(100)).alias("query"))
    tokens = F.array_distinct(F.flatten(F.transform("texts", text_tokens)))
    likeness = overlap_coefficient(text_tokens(F.col("text")), tokens)
    scored = asked.join(result_items(results), "query").withColumn("likeness", likeness)
    good = F.when(F.col("likeness") >= least, F.struct("rank", "title", "artist", "likeness"))
    best = scored.groupBy(*key).agg(F.min(good).alias("best"), F.count("*").alias("candidates"))
    audit = asked.drop("text").join(best, key, "left").select(
        *key, "query", "old_title", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.col("best.title").alias("best_title"), F.col("best.artist").alias("best_artist"),
        F.coalesce("best.likeness", F.lit(0.0)).alias("score"), F.col("best").isNotNull().alias("accepted"),
        F.when(F.col("best").isNotNull(), "lyrics_evidence_found").when(F.col("candidates").isNull(), "no_items").otherwise("insufficient_evidence").alias("reason"),
    )
    found = audit.where("accepted").select(*key, "best_title", "best_artist")
    named = matches.join(found, key, "left").withColumn("title", F.coalesce("best_title", "title")).withColumn("artist", F.coalesce("best_artist", "artist"))
    named = named.withColumn("tags", F.when(F.col("best_title").isNotNull(), F.concat_ws(",", F.nullif("tags", F.lit("")), F.lit("search_verified"))).otherwise(F.col("tags")))
    return named.select(*matches.columns), audit


def verify_titles(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """Matches (key, title) renamed after accepted evidence, with a verdict."""
    rows = matches.join(evidence.select("key", F.col("title").alias("found")), "key", "left")
    unknown = unknown_prefix(F.col("title"))
    verdict = F.when(F.col("found").isNull(), "no_evidence").when(unknown, "renamed").otherwise("confirmed")
    return rows.select("key", F.when(verdict == "renamed", F.col("found")).otherwise(F.col("title")).alias("title"), verdict.alias("verdict"))


def title_in_results(matches: DataFrame, results: DataFrame) -> DataFrame:
    """Matches (key, title, artist) with supported: title, and artist if any, occur in one of their own results' texts."""
    text = F.lower(F.concat_ws(" ", "r_title", "snippet"))
    own = results.select("key", F.col("title").alias("r_title"), "snippet")
    hit = F.contains(text, F.lower("title")) & ((F.coalesce("artist", F.lit("")) == "") | F.contains(text, F.lower("artist")))
    found = matches.join(own, "key").where(hit).select("key").distinct().withColumn("supported", F.lit(True))
    return matches.join(found, "key", "left").select("key", F.coalesce("supported", F.lit(False)).alias("supported"))


def recover_titles(files: DataFrame, titles: DataFrame, *, by_place: bool = False) -> DataFrame:
    """Titles of garbled files (folder, stem): the one of the folder whose first four characters the stem holds, else the one of the stem's leading number.

    Where a stem holds the beginnings of several titles the first one listed
    counts, or with by_place the one that stands first in the stem. An empty
    title has no beginning. They meet by the beginning, not by the folder.
    """
    bad = files.where(garbled(F.col("stem")))
    places = F.sequence(F.lit(1), F.length("stem"))
    starts = lambda n: F.filter(F.transform(places, lambda i: F.struct(F.substring("stem", i, F.lit(n)).alias("begin"), i.alias("place"))), lambda x: F.length(x["begin"]) == n)
    held = bad.select("folder", "stem").distinct().select("folder", "stem", F.inline(F.concat(*map(starts, range(1, 5))))).groupBy("folder", "stem", "begin").agg(F.min("place").alias("place"))
    first = titles.where("title <> ''").groupBy("folder", F.substring("title", 1, 4).alias("begin")).agg(F.min(F.struct("index", "title")).alias("t"))
    order = F.struct(F.col("place") if by_place else F.lit(0).alias("place"), "t.index", "t.title")
    near = held.join(first, ["folder", "begin"]).groupBy("folder", "stem").agg(F.min(order)["title"].alias("near"))
    number = F.regexp_extract("stem", "^([0-9]+)", 1).try_cast("long")
    by_number = titles.select("folder", F.col("index").alias("number"), F.col("title").alias("numbered"))
    return bad.withColumn("number", number).join(by_number, ["folder", "number"], "left").join(near, ["folder", "stem"], "left").select("folder", "stem", F.coalesce("near", "numbered").alias("title"))


def rename_plan(clips: DataFrame) -> DataFrame:
    """(folder, stem, target) of clips (folder, stem, streamer, title, artist, date): targets already planned get _2, _3, ..."""
    rows = clips.withColumn("base", clip_stem(F.col("streamer"), F.col("title"), F.col("artist"), F.col("date")))
    n = F.row_number().over(Window.partitionBy("folder", "base").orderBy("stem"))
    return rows.select("folder", "stem", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n)).alias("target"))
