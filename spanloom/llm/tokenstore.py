"""Binary token files with a minimal perfect hash over document keys.

A store is a folder of shards in ascending key order. A shard has two files:

- ``.ids``: the ids of its documents, one after another, as little-endian
  unsigned integers of the store's width (2 bytes, or 4 for vocabularies above
  65,536), with nothing between them.
- ``.idx``: an ``.npz`` of the hash's bit levels and, by slot, a 32-bit
  fingerprint of the key, the offset of its first id and its number of ids.
  Rows that repeat a key follow each other, and the slot also has their number.

A manifest (Parquet) lists shard, files, key range, rows and ids. Files carry
the attempt's name and only the manifest of finished tasks refers to them, so
tasks that run again or twice do no harm.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import new_path, partitions, table

SHARD_ROWS = 1 << 20
_NULL_KEY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, so that each level and the fingerprint see other bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by levels: keys that land alone are placed, the rest go down a level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, n = [], 0
        self.ranks = []
        for bits in levels:
            self.before.append(n)
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1)
            n += int(bits.sum())

    @staticmethod
    def build(keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        """For distinct keys (uint64)."""
        levels = []
        while len(keys):
            size = max(1, int(room * len(keys)))
            at = (_mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for some that are not in the set (the fingerprint tells the others)."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (_mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def _keys(column: pa.Array) -> np.ndarray:
    keys = _mix(np.asarray(column.fill_null(0)).astype(np.int64).view(np.uint64), 2000)
    keys[np.asarray(column.is_null())] = _NULL_KEY
    return keys


class PieceEncoder:
    """Texts to ids with the library's byte-level model, each distinct piece encoded once while remembered.

    With ``added`` the tokenizer's added tokens in a text give their own ids, as
    the library's encode does; without, they are ordinary text.
    """

    def __init__(self, path: str, pattern: str, max_pieces: int = 400_000, added: bool = False):
        from tokenizers import Tokenizer

        from spanloom.llm.pretokens import splitter

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.dtype = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.split, self.max_pieces = splitter(pattern), max_pieces
        self.known: dict[str, bytes] = {}
        marks = tokenizer.get_added_tokens_decoder() if added else {}
        self.added = {t.content: np.array([i], self.dtype).tobytes() for i, t in marks.items() if t.content}
        # The longest token wins; tokens that take blanks or need word ends are left to the library.
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.whole = tokenizer if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in marks.values()) else None
        # The model's letters for bytes: printable ones stand for themselves, the rest follow U+0100 in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in shown)}

    def encode(self, text: str) -> bytes:
        if self.whole is not None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if self.marks is None or not self.marks.search(text):
            return self._ordinary(text)
        return b"".join([self.added[x] if k % 2 else self._ordinary(x) for k, x in enumerate(self.marks.split(text))])

    def _ordinary(self, text: str) -> bytes:
        pieces, known = self.split(text), self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        if len(known) > self.max_pieces:
            known.clear()
        letters, tokenize, out = self.letters, self.model.tokenize, []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = np.array([t.id for t in tokenize("".join([letters[b] for b in p.encode()]))], self.dtype).tobytes()
                if len(p) < 64:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, added: bool) -> PieceEncoder:
    """One for each Python worker, so that tasks share what it remembers."""
    return PieceEncoder(path, pattern, added=added)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = 2, shards: int | None = None, added: bool = False) -> DataFrame:
    """Encodes docs, writes the store to path (a new folder of the shared store) and returns its manifest.

    Rows go in ascending key order, null keys first, repeated keys by text. A
    null text counts as empty; each document's ids end with end_id. With added
    the tokenizer's added tokens have their own ids. An empty table gives a
    store without shards. Without ``shards`` there are as many as shuffle
    partitions, or more, so that a shard has about SHARD_ROWS rows at most: its
    index is made in a task's memory. Other columns are not read.
    """
    spark = docs.sparkSession
    shards = shards or max(partitions(spark), -(-docs.count() // SHARD_ROWS))
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange(shards, "k").sortWithinPartitions("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder, out = TaskContext.get().partitionId(), None, None
        keys, sizes, low, high, seen = [], [], None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = _encoder(tokenizer_path, pattern, added)
                dtype = encoder.dtype
                end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
                store, place = pafs.FileSystem.from_uri(path)
                store.create_dir(place, recursive=True)
                name = f"{shard:06d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{place}/{name}.ids")
            for t in batch.column(1).to_pylist():
                ids = encoder.encode(t) + end
                out.write(ids)
                sizes.append(len(ids) // int(dtype[2]))
            keys.append(_keys(batch.column(0)))
            found = [k for k in (batch.column(0)[0].as_py(), batch.column(0)[-1].as_py()) if k is not None]
            low, high = (min(found) if low is None else low, max(found)) if found else (low, high)
            seen += batch.num_rows
        if out is None:
            return
        out.close()
        every, size = np.concatenate(keys), np.array(sizes, np.int64)
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        distinct, repeats, offset = every[first], np.diff(np.r_[first, len(every)]), np.cumsum(size) - size
        mph = PerfectHash.build(distinct)
        slot = mph.slots(distinct)
        arrays = {"fingerprint": _fingerprint(distinct), "row": first, "repeats": repeats}
        placed = {}
        for k, v in arrays.items():
            placed[k] = np.empty_like(v)
            placed[k][slot] = v
        buffer = io.BytesIO()
        np.savez(buffer, offset=offset, size=size, **placed, **{f"level{k:03d}": np.packbits(b) for k, b in enumerate(mph.levels)}, lengths=np.array([len(b) for b in mph.levels], np.int64))
        with store.open_output_stream(f"{place}/{name}.idx") as f:
            f.write(buffer.getvalue())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((shard, pa.int32()), (name, pa.string()), (low, pa.int64()), (high, pa.int64()), (seen, pa.int64()), (int(size.sum()), pa.int64()), (dtype, pa.string()))],
            ["shard", "name", "low", "high", "n_rows", "n_ids", "dtype"],
        )

    ordered.mapInArrow(write, "shard int, name string, low long, high long, n_rows long, n_ids long, dtype string").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


class Shard:
    """Keyed access to one shard."""

    def __init__(self, path: str, name: str, dtype: str):
        store, place = pafs.FileSystem.from_uri(path)
        with store.open_input_file(f"{place}/{name}.idx") as f:
            index = np.load(io.BytesIO(f.read()))
        lengths = index["lengths"]
        self.hash = PerfectHash([np.unpackbits(index[f"level{k:03d}"], count=n).astype(bool) for k, n in enumerate(lengths)])
        self.fingerprint, self.row, self.repeats, self.offset, self.size = (index[k] for k in ("fingerprint", "row", "repeats", "offset", "size"))
        self.ids, self.width = store.open_input_file(f"{place}/{name}.ids"), int(dtype[2])
        self.dtype = dtype

    def rows(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(place in keys, first id, number of ids) of every row found."""
        slot = self.hash.slots(keys)
        good = np.flatnonzero((slot >= 0) & (self.fingerprint[slot] == _fingerprint(keys)))
        return [(int(i), int(self.offset[r]), int(self.size[r])) for i in good for r in range(self.row[slot[i]], self.row[slot[i]] + self.repeats[slot[i]])]

    def read(self, offset: int, size: int) -> np.ndarray:
        return np.frombuffer(self.ids.read_at(size * self.width, offset * self.width), self.dtype)


def look_up(keys: DataFrame, path: str, *, key: str = "doc_id", digests: bool = True) -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32 or ids) for each distinct key found in the store at path.

    The manifest, a row for each shard, is read by the driver; keys are sent to
    their shard's task, which answers from the shard's index and payload.
    """
    spark: SparkSession = keys.sparkSession
    shards = sorted(spark.read.parquet(f"{path}/manifest").collect(), key=lambda r: r["shard"])
    starts = np.cumsum([0, *(r["n_ids"] for r in shards)]).tolist()
    highs = np.array([np.iinfo(np.int64).min if r["high"] is None else r["high"] for r in shards], np.int64)
    names, dtypes = [r["name"] for r in shards], [r["dtype"] for r in shards]
    answer = f"{key} long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<int>")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            at = np.searchsorted(highs, np.asarray(col.fill_null(np.iinfo(np.int64).min)))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(at, max(0, len(highs) - 1)).astype(np.int32)), col], ["shard", "k"])

    def answer_from(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: tuple[int, Shard | None] = (-1, None)
        for batch in batches:
            shard, col = np.asarray(batch.column(0)), batch.column(1)
            hashed, values = _keys(col), col.to_pylist()
            out: list[tuple] = []
            for s in np.unique(shard).tolist() if names else []:
                if loaded[0] != s:
                    loaded = (s, Shard(path, names[s], dtypes[s]))
                at = np.flatnonzero(shard == s)
                for i, offset, n in loaded[1].rows(hashed[at]):
                    ids = loaded[1].read(offset, n)
                    out.append((values[at[i]], starts[s] + offset, n, zlib.crc32(ids.astype("<u4").tobytes()) if digests else ids.astype(np.int32)))
            last = pa.int64() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), last))], [key, "start", "n_tokens", "ids_crc32" if digests else "ids"])

    wanted = keys.select(F.col(key).cast("long").alias("k")).distinct()
    routed = wanted.mapInArrow(route, "shard int, k long").repartition(max(1, len(names)), "shard").sortWithinPartitions("shard", "k")
    return routed.mapInArrow(answer_from, answer)


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "tokens")
    write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)
    return look_up(docs.select("doc_id"), path)
