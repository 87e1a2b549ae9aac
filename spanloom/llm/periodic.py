"""Periodic runs of words by an online dynamic program over sparse diagonals.

A lag is active at a word where the word's earlier occurrence that lag before
prolongs a match of the words before both. To keep the diagonals sparse, an
earlier occurrence counts only if the whole stretch of 2^k words up to it is the
same, and of those only the latest: inside a run of period p with
2^(k-1) <= p < 2^k that occurrence lies exactly p words back, and no other lag is
active there, so a word has at most one active lag for each k and a text of n
words costs O(n log n), however often its words occur. Each occurrence makes its
lag's match one word longer; where the next word does not, the diagonal ends, and
what is long enough goes out as a run. Stretches are named by doubling (the names
of two halves), so nothing is told by hashes. All documents of a batch go through
one pass; names hold the document, and lags are shorter than stretches, so no
match crosses documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from spanloom.llm.shared import table

LEAST_WORDS, LEAST_PERIODS = 6, 4
BATCH_BYTES = 8 << 20


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, and where those of each text begin (one more entry for the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    starts = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return flat.filter(real).dictionary_encode(), starts


def runs_of(words: np.ndarray, starts: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; starts count words of the whole batch.

    A run is a maximal stretch with smallest period p of at least max(least,
    periods * p) words; periods must be 3 at least.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found = []
    name = np.unique(doc * (int(words.max(initial=0)) + 1) + words, return_inverse=True)[1].astype("i8") if n else np.zeros(0, "i8")
    half, ends = 1, np.arange(n)  # stretches of half words that occur again, by their last word
    while len(ends := ends[(ends >= half)]):
        ends = ends[(name[ends] >= 0) & (name[ends - half] >= 0) & (doc[ends] == doc[ends - half])]
        if not len(ends):
            break
        named = np.unique(name[ends - half] * (n + 1) + name[ends], return_inverse=True)[1]
        again = np.bincount(named)[named] > 1
        ends, named = ends[again], named[again]
        name = np.full(n, -1, "i8")
        name[ends] = named
        order = np.argsort(named, kind="stable")
        at, key = ends[order], named[order]
        lag = at[1:] - at[:-1]
        near = (key[1:] == key[:-1]) & (lag >= half) & (lag < 2 * half)
        found.append(_diagonals(at[1:][near], lag[near], 2 * half, least, periods))
        half *= 2
    out = np.concatenate(found) if found else np.zeros((0, 3), "i8")
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _diagonals(at: np.ndarray, lag: np.ndarray, size: int, least: int, periods: int) -> np.ndarray:
    """Runs of the diagonals on which stretches of ``size`` words ending at ``at`` occurred ``lag`` words before."""
    order = np.argsort(at)
    at, lag = at[order], lag[order]
    ends = np.flatnonzero(np.append((np.diff(at) != 1) | (np.diff(lag) != 0), True)) if len(at) else np.zeros(0, "i8")
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    period = lag[begins]
    length = at[ends] - at[begins] + size + period
    rows = np.stack([at[ends] - length + 1, length, period], 1)
    return rows[length >= np.maximum(least, periods * period)]


def _batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES of text; one text is never divided."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("i8"))
        cuts = np.flatnonzero(np.diff(size // BATCH_BYTES, prepend=0) > 0).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def _joined(words: pa.DictionaryArray, which: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Texts of the chosen words, joined by one space; ``starts`` counts chosen words."""
    lists = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), words.dictionary.take(words.indices.take(pa.array(which))))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def with_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """docs with n_words, runs (start, length, period, by start and period) and collapsed, the text's words joined by one space without those a run repeats.

    Words are stretches without ASCII white space; a null text has none. All rows
    stay, repeated ones each. A table that has such a column already is refused.
    """
    new = [StructField("n_words", LongType()), StructField("runs", RUNS), StructField("collapsed", StringType())]
    if taken := {f.name for f in new} & set(docs.columns):
        raise ValueError(f"the table has columns {sorted(taken)} already")
    if periods < 3:
        raise ValueError("runs of fewer than three periods are not found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, text):
            words, starts = words_of(batch.column(text))
            codes = words.indices.to_numpy()
            rows = runs_of(codes, starts, least, periods)
            over = np.zeros(len(codes) + 1, "i8")
            np.add.at(over, rows[:, 0] + rows[:, 2], 1)
            np.add.at(over, rows[:, 0] + rows[:, 1], -1)
            kept = np.cumsum(over)[:-1] == 0
            collapsed = _joined(words, np.flatnonzero(kept), np.concatenate([[0], np.cumsum(kept)])[starts])
            first = np.searchsorted(rows[:, 0], starts)
            of = np.searchsorted(starts, rows[:, 0], "right") - 1
            struct = pa.StructArray.from_arrays([pa.array(rows[:, 0] - starts[of]), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(starts), pa.int64()), lists, collapsed], [*batch.schema.names, *(f.name for f in new)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *new]))


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones the first by start, then period. Null without runs."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))


def with_repeats_made(docs: DataFrame) -> DataFrame:
    """The query's texts: of each tenth document (by crc32 of doc_id) the words from some place on repeat with some period. Documents without an id stay as they are."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, "text"):
            h = batch.column("h")
            chosen = pc.fill_null(pc.equal(pc.subtract(h, pc.multiply(pc.divide(h, 10), 10)), 0), False)
            some = batch.filter(chosen)
            words, starts = words_of(some.column("text"))
            which = np.arange(len(words))
            for g, low, high in zip((some.column("h").to_numpy() // 10).tolist(), starts[:-1].tolist(), starts[1:].tolist()):
                if n := high - low:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    which[low + a : high] = low + a + np.arange(n - a) % p
            text = pc.replace_with_mask(batch.column("text"), chosen, _joined(words, which, starts).cast(batch.column("text").type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"])

    return rows.mapInArrow(run, StructType([docs.schema["doc_id"], docs.schema["text"]]))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document: their number, the strongest, digests of all runs and of the collapsed text."""
    rows = with_runs(with_repeats_made(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    milli = F.expr("best.length * 1000 div best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
