"""Removal of passages that an earlier document has, by suffix order.

A byte goes if some string of ``width`` bytes that covers it also starts in a
document with a smaller key. Texts of all documents are never sorted together:

1. Every string of ``width`` bytes has an anchor, its 20-byte piece of least
   hash, and neighbouring strings mostly share it. The strings of one anchor
   form its stretch of the text. Equal strings have equal anchors, so only
   stretches of equal anchors need comparing, one record standing for about 16
   bytes of text. A batch sends one record for copies it holds itself.
2. Records meet by anchor. Stretches equal to one of a smaller key are removed
   whole. An anchor with different stretches keeps the first of each.
3. The bytes of those stretches are fetched and sorted by suffix, anchor by
   anchor, with linear grouping; runs of suffixes that share ``width`` bytes are
   equal strings, and those of larger keys are removed.
4. The removed ranges of a document are joined and cut out of its text.

Records are packed column by column into blobs, one for each batch and range of
hashes, and texts travel compressed. The stretches of anchors with very many
different ones are cut into their single strings, which are never sorted: they
go through step 2 once more, with two hashes of the string for anchor and
content, and those of larger keys go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import partitions, stored, table
from spanloom.llm.suffixes import suffix_order

WIDTH, PIECE = 50, 20
_M = 0xD6E8FEB86659FD93


def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _u64(_M)
        return x ^ (x >> np.uint64(29))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, by doubling."""
    with np.errstate(over="ignore"):
        h = data.astype(np.uint64) * _u64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out, length, factor, have, by = None, 1, _M, 0, 1
        while True:
            if size & length:
                if out is None:
                    out, have, by = h, length, factor
                else:
                    n = len(data) - have - length + 1
                    out = h[:n] * _u64(by) + out[length : length + n]
                    have, by = have + length, by * factor
            length *= 2
            if length > size:
                return _mix(out)
            h = h[: len(h) - length // 2] * _u64(factor) + h[length // 2 :]
            factor *= factor


def stretches(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first string, number of strings less one) of each stretch; the text has WIDTH bytes at least."""
    h, span = rolling(data, PIECE), WIDTH - PIECE + 1
    low, size = h, 1
    while 2 * size <= span:
        low, size = np.minimum(low[: len(low) - size], low[size:]), 2 * size
    n = len(data) - WIDTH + 1
    least = np.minimum(low[:n], low[span - size : span - size + n])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[first, n])
    cuts = -(-size // span)  # periodic text repeats its anchor; its stretches are cut to at most span strings
    if len(first) < cuts.sum():
        turn = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, size = np.repeat(first, cuts) + turn * span, np.minimum(np.repeat(size, cuts) - turn * span, span)
    more = size - 1
    g = rolling(data, WIDTH)
    with np.errstate(over="ignore"):  # strings of WIDTH bytes at both ends cover the stretch, for it has less than twice as many
        content = _mix(_mix(g[first] + more.astype(np.uint64)) + g[first + more] * np.uint64(3))
    return least[first], content, first, more


def _pack(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, tag: np.ndarray, first: np.ndarray, more: np.ndarray) -> bytes:
    """Records in document order; 48 bits of each hash beside those that chose the blob."""
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    six = lambda x: x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    rest = [doc[starts].astype("<i8"), tag[starts].astype("<u2"), np.diff(np.r_[starts, len(doc)]).astype("<u4"), np.diff(first, prepend=0).astype("<i4"), more.astype("<u2")]
    tail = zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in rest))
    return np.array([len(doc), len(starts)], "<u4").tobytes() + six(anchor) + six(content) + tail


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, k = np.frombuffer(blob, "<u4", 2).tolist()

    def six(at: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
        return out.reshape(-1).view(np.uint64)

    tail = zstandard.ZstdDecompressor().decompress(blob[8 + 12 * n :])
    cols, at = [], 0
    for kind, m in (("<i8", k), ("<u2", k), ("<u4", k), ("<i4", n), ("<u2", n)):
        cols.append(np.frombuffer(tail, kind, m, at))
        at += cols[-1].nbytes
    doc, tag, runs, first, more = cols
    return six(8), six(8 + 6 * n), np.repeat(doc, runs), np.repeat(tag, runs), np.cumsum(first, dtype=np.int64), more.astype(np.int64)


def _blobs(cols: list[np.ndarray], parts: int) -> tuple[np.ndarray, list[bytes]]:
    """(part, blob) of records (anchor, content, key, tag, first, more), dealt by anchor; copies of a record at hand with a smaller key go to the parts from ``parts`` on."""
    content, doc = cols[1], cols[2]
    order = np.argsort(content, kind="stable")
    new = np.flatnonzero(np.r_[True, content[order][1:] != content[order][:-1]])
    least = np.repeat(np.minimum.reduceat(doc[order], new), np.diff(np.r_[new, len(order)]))
    copy = np.empty(len(order), bool)
    copy[order] = doc[order] > least
    part = (cols[0] >> np.uint64(44)).astype(np.int64) % parts
    part[copy] = parts + doc[copy] % parts
    by = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, part[by][1:] != part[by][:-1]])
    return part[by[cuts]].astype(np.int32), [_pack(*(x[by[i:j]] for x in cols)) for i, j in zip(cuts, np.r_[cuts[1:], len(by)])]


def _scan(parts: int):
    """(key, tag, text) to (part, blob): records by anchor; from part ``parts`` on, stretches found to be copies already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
            found = []
            for i, t in enumerate(batch.column(2).to_pylist()):
                data = np.frombuffer(t.encode(), np.uint8)
                if len(data) >= WIDTH:
                    a, c, f, m = stretches(data)
                    found.append((a, c, np.full(len(a), keys[i]), np.full(len(a), tags[i]), f, m))
            if not found:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _blobs([np.concatenate(x) for x in zip(*found)], parts)], ["part", "blob"])

    return run


_RANGES = ["key", "tag", "first", "more", "anchor", "hot"]


def _resolve(parts: int, hot: int):
    """Blobs, sorted by part, to ranges (key, tag, first, more, anchor, hot): anchor is null for copies, and set for stretches still to compare; hot: its anchor has more than ``hot`` of them."""

    def settle(part: int, blobs: list[bytes]) -> pa.RecordBatch | None:
        anchor, content, doc, tag, first, more = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
        if part >= parts:
            out, open_ = np.arange(len(doc)), np.zeros(len(doc), bool)
            crowd = open_
        else:
            order = np.lexsort((doc, content, anchor))
            anchor, content, doc, tag, first, more = (x[order] for x in (anchor, content, doc, tag, first, more))
            new_a = np.r_[True, anchor[1:] != anchor[:-1]]
            new_c = new_a | np.r_[True, content[1:] != content[:-1]]
            own_first = np.maximum.accumulate(np.where(new_c, np.arange(len(doc)), 0))
            copy = doc > doc[own_first]
            group, starts = np.cumsum(new_a) - 1, np.flatnonzero(new_a)
            mixed = (np.bincount(group[new_c]) > 1) & (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
            # Equal stretches of the smallest key, repeats inside one document among them, are all compared.
            open_ = ~copy & mixed[group]
            crowd = np.bincount(group, open_)[group] > hot
            out = np.flatnonzero(copy | open_)
        if not len(out):
            return None
        cols = [pa.array(doc[out]), pa.array(tag[out].astype(np.int32)), pa.array(first[out].astype(np.int32)), pa.array(more[out].astype(np.int32))]
        marks = pa.array(anchor[out].view(np.int64) ^ (part << 48), mask=~open_[out])
        return pa.RecordBatch.from_arrays([*cols, marks, pa.array(crowd[out] & open_[out])], _RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now or part >= parts:
                    if held and (done := settle(now, held)) is not None:
                        yield done
                    now, held = part, []
                held.append(blob)
        if held and (done := settle(now, held)) is not None:
            yield done

    return run


def _squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, tag, text) to (key, tag, z): the text compressed."""
    c = zstandard.ZstdCompressor(level=3)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["key", "tag", "z"])


def strings(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string of WIDTH bytes, the second one from those of its halves."""
    half = rolling(data, WIDTH // 2)
    with np.errstate(over="ignore"):
        return rolling(data, WIDTH), _mix(_mix(half[: len(data) - WIDTH + 1]) + half[WIDTH // 2 :] * np.uint64(3))


def _cut_out(parts: int, most: int = 1 << 22):
    """(key, tag, z, stretches) to (anchor, key, tag, first, bytes, part): pieces to be sorted; hot stretches give blobs with a record for each of their strings instead, which have a part."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())

    def pack(out: list[tuple], hot: list[tuple]) -> pa.RecordBatch:
        if hot:
            key, tag, first, pieces = zip(*hot)
            sizes = np.array([len(p) for p in pieces])
            n = sizes - WIDTH + 1
            turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(np.cumsum(sizes) - sizes, n) + turn
            anchor, content = strings(np.frombuffer(b"".join(pieces), np.uint8))
            cols = [anchor[at], content[at], np.repeat(key, n), np.repeat(tag, n), np.repeat(first, n) + turn, np.zeros(len(at), np.int64)]
            out = out + [(None, None, None, None, blob, part) for part, blob in zip(*_blobs(cols, parts))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["anchor", "key", "tag", "first", "bytes", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            hot: list[tuple] = []
            size = 0
            for key, tag, z, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                data = d.decompress(z)
                for anchor, first, more, many in zip(*(rows.values.field(k).to_pylist() for k in range(4))):
                    piece = data[first : first + more + WIDTH]
                    size += len(piece)
                    if many:
                        hot.append((key, tag, first, piece))
                    else:
                        out.append((anchor, key, tag, first, piece, None))
                if size >= most:
                    yield pack(out, hot)
                    out, hot, size = [], [], 0
            yield pack(out, hot)

    return run


def repeated_strings(pieces: list[bytes], keys: list[int]) -> list[tuple[int, int, int]]:
    """(piece, first, last) runs of strings of WIDTH bytes in pieces that also occur in a piece of a smaller key."""
    text: list[int] = []
    owner: list[int] = []
    begin = []
    for k, piece in enumerate(pieces):
        begin.append(len(text))
        text += [b + 1 for b in piece]
        text.append(0)
        owner += [k] * (len(piece) + 1)
    joined = b"".join(p + b"\0" for p in pieces)
    flagged: list[list[int]] = [[] for _ in pieces]
    now, run = None, []

    def close() -> None:
        if len(run) > 1:
            least = min(keys[owner[i]] for i in run)
            for i in run:
                if keys[owner[i]] > least:
                    flagged[owner[i]].append(i - begin[owner[i]])

    for i in suffix_order(text):
        k = owner[i]
        if i - begin[k] + WIDTH > len(pieces[k]):
            continue
        string = joined[i : i + WIDTH]
        if string != now:
            close()
            now, run = string, []
        run.append(i)
    close()
    out = []
    for k, starts in enumerate(flagged):
        starts.sort()
        for s in starts:
            if out and out[-1][0] == k and out[-1][2] == s - 1:
                out[-1][2] = s
            else:
                out.append([k, s, s])
    return [tuple(x) for x in out]


def _shared(pieces: list[bytes], keys: list[int]) -> list[tuple[int, int, int]]:
    """(piece, first, last) from the first to the last string whose hash occurs under two keys; pieces without one drop out."""
    sizes = np.array([len(p) for p in pieces])
    n = sizes - WIDTH + 1
    begin = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h, key = rolling(np.frombuffer(b"".join(pieces), np.uint8), WIDTH)[begin[piece] + start], np.array(keys)[piece]
    order = np.argsort(h, kind="stable")
    runs = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    mixed = np.minimum.reduceat(key[order], runs) < np.maximum.reduceat(key[order], runs)
    hit = np.sort(order[np.repeat(mixed, np.diff(np.r_[runs, len(h)]))])
    if not len(hit):
        return []
    heads = np.flatnonzero(np.r_[True, piece[hit][1:] != piece[hit][:-1]])
    tails = np.r_[heads[1:], len(hit)] - 1
    return list(zip(piece[hit[heads]].tolist(), start[hit[heads]].tolist(), start[hit[tails]].tolist()))


def _sort_suffixes(most: int = 1 << 18):
    """Pieces, sorted by anchor, to ranges. Groups are sorted together, up to ``most`` bytes or one group.

    Pieces are cut to what may be shared. Of equal ones the smallest key's
    stands for all, and the others are copies as a whole.
    """

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        found: list[tuple[int, int, int, int]] = []
        alike: dict[bytes, list[tuple[int, int, int]]] = {}
        for k, first, last in _shared([r[4] for r in rows], [r[1] for r in rows]):
            _, key, tag, base, piece = rows[k]
            alike.setdefault(piece[first : last + WIDTH], []).append((key, tag, base + first))
        least = {piece: min(owners)[0] for piece, owners in alike.items()}
        for piece, owners in alike.items():
            found += [(key, tag, first, len(piece) - WIDTH) for key, tag, first in owners if key > least[piece]]
        pieces = list(alike)
        for k, a, b in repeated_strings(pieces, [least[p] for p in pieces]):
            found += [(key, tag, first + a, b - a) for key, tag, first in alike[pieces[k]] if key == least[pieces[k]]]
        cols = list(zip(*found)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])], _RANGES[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for a, key, tag, first, piece in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= most and held[-1][0] != a:
                    yield settle(held)
                    held, size = [], 0
                held.append((a, key, tag, first, piece))
                size += len(piece)
        if held:
            yield settle(held)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, z, ranges) to the digest columns; ranges hold first << 20 | more, or are null."""
    d = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for key, z, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data, kept, at, spans, gone = d.decompress(z), hashlib.sha256(), 0, 0, 0
            high = -1
            for r in sorted(ranges or []):
                low, end = r >> 20, (r >> 20) + (r & 0xFFFFF) + WIDTH
                if low > high:
                    spans += 1
                    kept.update(data[at:low])
                    gone += end - low
                elif end > high:
                    gone += end - high
                at = high = max(high, end)
            kept.update(data[at:])
            out.append((key, len(data), gone, spans, kept.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", hot: int = 4096) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Null texts count as empty. Rows of one key never remove each other's bytes,
    and rows without a key neither remove nor lose any. Texts of fewer than 50
    bytes stay whole. An empty table gives an empty result; other columns are
    not read. Hashes only choose what is compared, but for stretches found
    equal in step 2, whose content hash (48 bits, within one anchor) is trusted;
    so are the two hashes (48 bits each) of the strings of hot anchors.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    parts = 4 * n
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.pmod(F.xxhash64(body), F.lit(1 << 16)).cast("int").alias("tag"), body.alias("t"))
    keyed = rows.where("key is not null")
    settled = lambda blobs: blobs.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_resolve(parts, hot), "key long, tag int, first int, more int, anchor long, hot boolean")
    ranges = stored(settled(keyed.mapInArrow(_scan(parts), "part int, blob binary")), "ranges", release=True)

    wanted = ranges.where("anchor is not null").groupBy("key", "tag").agg(F.collect_list(F.struct("anchor", "first", "more", "hot")).alias("rs"))
    packed = keyed.mapInArrow(lambda it: (_squeeze(b) for b in it if b.num_rows), "key long, tag int, z binary")
    pieces = stored(packed.join(wanted, ["key", "tag"]).mapInArrow(_cut_out(parts), "anchor long, key long, tag int, first int, bytes binary, part int"), "pieces", release=True)
    sorted_ = pieces.where("part is null").select("anchor", "key", "tag", "first", "bytes").repartition(n, "anchor").sortWithinPartitions("anchor")
    # Equal records are equal strings here, so no string is left open.
    single = settled(pieces.where("part is not null").select("part", F.col("bytes").alias("blob"))).where("anchor is null").select("key", "tag", "first", "more")
    compared = stored(sorted_.mapInArrow(_sort_suffixes(), "key long, tag int, first int, more int").union(single), "compared", release=True)

    # A document lists each of its stretches at most once a step, so its list is as long as its text at most.
    gone = ranges.where("anchor is null").select("key", "tag", "first", "more").union(compared)
    gone = gone.groupBy("key", "tag").agg(F.collect_list(F.shiftleft(F.col("first").cast("long"), 20).bitwiseOR(F.col("more").cast("long"))).alias("rs"))
    every = rows.mapInArrow(lambda it: (_squeeze(b) for b in it if b.num_rows), "key long, tag int, z binary")
    out = every.join(gone, ["key", "tag"], "left").select("key", "z", "rs")
    return out.mapInArrow(_remove, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
