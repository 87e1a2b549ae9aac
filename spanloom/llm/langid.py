"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language in order of
frequency. A document's own most frequent n-grams are compared with each
profile by the out-of-place distance: the sum of rank differences, a missing
n-gram counting as far as the profile is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.shared import cut, sliced, table

_MARK = np.uint64(0x1FFFFF)
_ALPHA: list[np.ndarray] = []
_STEP = 1 << 19
MOST_LANGUAGES = 10_000


def _alpha() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def _letters(part: str, after_letter: bool) -> np.ndarray:
    """Code points of letters, with one 0 for each run of other characters that follows a letter."""
    points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _alpha()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[:1] |= after_letter
    return np.where(letter, points, 0)[kept].astype(np.uint64)


def _codes(y: np.ndarray, seen: int) -> np.ndarray:
    """Codes of the n-grams of y that end after its first ``seen`` values: single letters, pairs with a letter, triples around one."""
    one = y[seen:]
    pair = ((y[:-1] > 0) | (y[1:] > 0))[max(0, seen - 1) :]
    two = ((y[:-1] << np.uint64(21)) | y[1:] | (_MARK << np.uint64(42)))[max(0, seen - 1) :][pair]
    around = (y[1:-1] > 0)[max(0, seen - 2) :]
    three = ((y[:-2] << np.uint64(42)) | (y[1:-1] << np.uint64(21)) | y[2:])[max(0, seen - 2) :][around]
    return np.concatenate([one[one > 0] | (_MARK << np.uint64(42)) | (_MARK << np.uint64(21)), two, three])


def gram_counts(text: str, step: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes and their counts over the whole text, letters lower-cased, other runs as one gap.

    Long texts are read ``step`` characters at a time; the last two values are
    carried over, so the counts are those of the text in one piece.
    """
    low = text.lower()
    carried, parts = np.zeros(1, np.uint64), []
    for i in range(0, max(1, len(low)), step):
        new = _letters(low[i : i + step], bool(carried[-1]))
        if i + step >= len(low) and len(new) and new[-1] or (i + step >= len(low) and not len(new) and carried[-1]):
            new = np.append(new, np.uint64(0))
        y = np.concatenate([carried, new])
        parts.append(np.unique(_codes(y, len(carried)), return_counts=True))
        carried = y[-2:]
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def top_grams(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first, ties by code."""
    if len(codes) > 4 * k:
        floor = np.partition(counts, len(counts) - k)[len(counts) - k]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.lexsort((codes, -counts))[:k]]


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn_profiles(train: DataFrame, *, text: str = "text", lang: str = "lang", length: int = 400, per_language: int = 3000) -> dict[str, list[int]]:
    """Profiles of each language of train's labelled rows.

    Languages with more than ``per_language`` rows are learned from about that
    many, chosen by the hash of their text: the documented bound of the sample.
    Counting runs on the executors; what returns is ``length`` codes a language,
    and more than 10,000 different labels are refused as no languages.
    """
    rows = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = cut(rows.groupBy("l").agg((F.lit(float(per_language)) / F.count("*")).alias("rate")))
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = F.broadcast(sizes)  # at most that many rows, so that texts stay where they are
    share = (F.xxhash64("t").bitwiseAND(F.lit((1 << 20) - 1))) / F.lit(float(1 << 20))
    chosen = rows.join(sizes, "l").where(share < F.col("rate")).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in sliced(batches):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = found.setdefault(name, [])
                parts.append(gram_counts(t))
                if len(parts) > 128:
                    parts[:] = [merged(parts)]
        for name, parts in found.items():
            codes, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["l", "gram", "n"])

    counts = chosen.mapInArrow(count, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("l").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    profiles: dict[str, list[int]] = {}
    for row in best.orderBy("l", "rank").select("l", "gram").toLocalIterator():
        profiles.setdefault(row[0], []).append(row[1])
    return profiles


class Ranker:
    """Distances of one text to all profiles, and the nearest."""

    def __init__(self, profiles: dict[str, list[int]], depth: int):
        self.names, self.depth = sorted(profiles), depth
        self.far = max([1, *map(len, profiles.values())])
        self.sorted = []
        for name in self.names:
            codes = np.array(profiles[name], np.int64).view(np.uint64)
            order = np.argsort(codes)
            self.sorted.append((codes[order], order.astype(np.int64)))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); ('und', 0) for null, for texts without a letter, and with nothing learned."""
        codes, counts = gram_counts(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        own = top_grams(codes, counts, self.depth)
        rank, best = np.arange(len(own)), (np.inf, "und")
        for name, (known, place) in zip(self.names, self.sorted):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            off = np.where(known[at] == own, np.minimum(np.abs(place[at] - rank), self.far), self.far)
            best = min(best, (float(off.sum()) / (len(own) * self.far), name))
        return best[1], 1.0 - best[0]


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], *, text: str = "text", depth: int = 300) -> DataFrame:
    """docs with lang_pred and score added.

    Nulls, empty texts and texts without letters give ('und', 0.0); ties go to
    the first language by name; repeated rows are each scored; an empty table
    gives an empty result. Columns of docs named like a result are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, depth)
        for batch in sliced(batches):
            found = [ranker.predict(t) for t in batch.column(at).to_pylist()]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(~is_held_out() & F.col("doc_id").isNotNull()))
    slim = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return predict_language(slim, profiles).select("doc_id", "held_out", "lang_pred", "score")
