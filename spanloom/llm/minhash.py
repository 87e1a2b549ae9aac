"""MinHash near-duplicates by a chosen-path set similarity join.

A document is its set of word shingles, and a signature of minwise hashes stands
for the set. In each of several independent trees a node is a group of documents
that agree on the coordinates chosen along a path; a node chooses its next
coordinates at random, 1/threshold of them on average, so a pair at the threshold
keeps meeting on average once at every depth. Small nodes are compared
exhaustively by signature. Large nodes are compared with some of their members
first, and branch only while they hold more than one component: a group of copies
ends at once, however large. Of what is still large after the last round, all that
is outside a node's largest component is compared with everything in the node, in
blocks and on the full sets; a block gives out only links that join components.
Every link is confirmed on the full sets.

Documents with equal sets are one class throughout, so copies are never paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.components import parents
from spanloom.llm.shared import Memory, by_batch, cut, partitions, sliced, stored, table

COORDINATES = 64


class Shingler:
    """Sets of hashed shingles, and their signatures."""

    def __init__(self, words: int, seed: int = 11, memory: int = 100_000):
        rng = np.random.default_rng(seed)
        self.words, self.known = words, Memory(xxhash.xxh3_64_intdigest, memory)
        self.powers = rng.integers(1, 1 << 63, words + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = rng.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(1, 1 << 63, COORDINATES, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingles as sorted 64-bit hashes. A-Z count as a-z; shorter texts are one shingle; no words, none."""
        known = self.known
        known.turn()
        h = np.array([known[w] for w in (text or "").encode().lower().split()], np.uint64)
        k, n = self.words, len(h)
        if not n:
            return h
        with np.errstate(over="ignore"):
            if n < k:
                s = np.array([(h * self.powers[:n]).sum() + np.uint64(n) * self.powers[k]], np.uint64)
            else:
                s = h[: n - k + 1] * self.powers[0]
                for i in range(1, k):
                    s += h[i : n - k + 1 + i] * self.powers[i]
            s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(s ^ (s >> np.uint64(29)))

    def signature(self, s: np.ndarray) -> np.ndarray:
        low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
        with np.errstate(over="ignore"):
            for i in range(0, len(s), 4096):
                low = np.minimum(low, (self.a[:, None] * s[None, i : i + 4096] + self.b[:, None]).min(1))
            return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _describe(words: int):
    """(id, text) to (id, n, digest of the set, signature); digest and signature are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in sliced(batches):
            n, digest, sig = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingler.shingles(t)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(shingler.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "digest", "sig"])

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _branch(threshold: float, steps: int, seed: int):
    """(node, cls, sig) to (node, cls) of the nodes ``steps`` choices further down; choices depend on the node alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.asarray(batch.column(0)).view(np.uint64)
            row, sig = np.arange(len(node)), _signatures(batch.column(2)).astype(np.uint64)
            for step in range(steps):
                draw = _mix(node + np.uint64(seed * 1000 + step))
                first = (draw % np.uint64(COORDINATES)).astype(np.int64)
                second = ((draw >> np.uint64(8)) % np.uint64(COORDINATES)).astype(np.int64)
                more = (draw >> np.uint64(20)).astype(np.float64) / 2.0**44 < 1 / threshold - 1
                more &= first != second
                row = np.concatenate([row, row[more]])
                chosen = np.concatenate([first, second[more]])
                node = np.concatenate([node, node[more]])
                with np.errstate(over="ignore"):
                    node = _mix(node * np.uint64(0x9E3779B97F4A7C15) + (chosen.astype(np.uint64) << np.uint64(33)) + sig[row, chosen] + np.uint64(step))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(1).take(pa.array(row))], ["node", "cls"])

    return run


def _pairs_in_node(floor: float, ratio: float):
    """Members of small nodes to pairs (a, b) of different components whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for members in batch.column(0):
                m = members.values
                ids, comp, size = (m.field(k).to_numpy() for k in range(3))
                sig = _signatures(m.field(3))
                for i in range(len(ids) - 1):
                    ok = comp[i + 1 :] != comp[i]
                    ok &= np.minimum(size[i + 1 :], size[i]) >= ratio * np.maximum(size[i + 1 :], size[i])
                    ok[ok] = (sig[i + 1 :][ok] == sig[i]).mean(1) >= floor
                    for j in np.flatnonzero(ok):
                        a, b = int(ids[i]), int(ids[i + 1 + j])
                        out_a.append(min(a, b))
                        out_b.append(max(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _star(floor: float):
    """(node, cls, sig, pivots) to (node, cls, mean agreement, a, b): the pairs with the first and the most similar pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, sig = np.asarray(batch.column(1)), _signatures(batch.column(2))
            mean, near = [], []
            for i, pivots in enumerate(batch.column(3)):
                p = pivots.values
                ids = p.field(0).to_numpy()
                share = (_signatures(p.field(1)) == sig[i]).mean(1)
                mean.append(float(share.mean()))
                good = [(int(c), float(x)) for c, x in zip(ids, share) if x >= floor and c != cls[i]]
                near.append(sorted({min(good)[0], max(good, key=lambda g: (g[1], -g[0]))[0]}) if good else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mean, pa.float64()), pa.array(near, pa.list_(pa.int64()))], ["node", "cls", "mean", "near"])

    return run


def _squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, text) with the text compressed, for the shuffles."""
    c = zstandard.ZstdCompressor(level=3)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["id", "text"])


def _confirm(words: int, percent: int):
    """Rows (a, salt, b, compressed text) sorted so that a's own rows are first: pairs (a, b) of which two sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, bases = Shingler(words), None, []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out_a, out_b = [], []
            for group, b, t in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                s = shingler.shingles(unpack(t).decode())
                if group != now:
                    now, bases = group, []
                if group[0] == b:
                    bases.append(s)
                    continue
                for base in bases:
                    inter = len(np.intersect1d(base, s, assume_unique=True))
                    if len(s) and 100 * inter >= percent * (len(base) + len(s) - inter):
                        out_a.append(group[0])
                        out_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _joined_in_blocks(words: int, percent: int):
    """Rows (cross, members of one block or two) to confirmed links (a, b), at most one for each component of the members.

    A member's set is marked in the shingles of all members, and their marks
    are summed by member: the sizes of its intersections with all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, unpack = Shingler(words), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out_a, out_b = [], []
            for cross, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = members.values
                ids, comp, side = (m.field(k).to_numpy() for k in range(3))
                sets = [shingler.shingles(unpack(t).decode()) for t in m.field(3).to_pylist()]
                size = np.array([len(s) for s in sets])
                begin = np.cumsum(size) - size
                place = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
                mark = np.zeros(int(place.max()) + 1, np.int32)
                _, root = np.unique(comp, return_inverse=True)
                for i in np.flatnonzero(side == side.min()):
                    other = root != root[i]
                    other &= side != side[i] if cross else np.arange(len(ids)) > i
                    if not other.any():
                        continue
                    own = place[begin[i] : begin[i] + size[i]]
                    mark[own] = 1
                    inter = np.add.reduceat(mark[place], begin)
                    mark[own] = 0
                    for j in np.flatnonzero(other & (100 * inter >= percent * (size + size[i] - inter))):
                        if root[j] != root[i]:
                            root[root == root[j]] = root[i]
                            out_a.append(int(min(ids[i], ids[j])))
                            out_b.append(int(max(ids[i], ids[j])))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def confirm_links(pairs: DataFrame, texts: DataFrame, *, words: int = 5, percent: int = 85, spread: int = 256) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets. texts has (cls, compressed text)."""
    salted = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(spread)).cast("int").alias("salt"), "b")
    degree = salted.groupBy("a").agg(F.ceil(F.count("*") / spread).cast("int").alias("salts"))
    salted = salted.join(degree, "a").select("a", F.pmod("salt", F.col("salts")).alias("salt"), "b")
    own = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("b"))
    rows = salted.union(own).join(texts.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "text")
    dealt = rows.repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b") != F.col("a"))
    return dealt.mapInArrow(_confirm(words, percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 85, words: int = 5, trees: int = 10, small: int = 48, rounds: int = 3, block: int = 150_000, seed: int = 3) -> DataFrame:
    """Rows (key, n_shingles, component_id, kept) for every row of docs.

    Null texts and texts without words have no shingles and no links. Repeated
    rows are copies; rows that share a key and differ in text count as one node
    of the graph. Rows without a key come back unlinked, kept. An empty table
    gives an empty result. Other columns of docs are not read. ``block`` is the
    number of shingles in a block of the last round.
    """
    threshold = percent / 100
    floor = threshold - 3.3 * (threshold * (1 - threshold) / COORDINATES) ** 0.5
    spark, rows = docs.sparkSession, docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    described = stored(rows.mapInArrow(_describe(words), "id long, n long, digest binary, sig binary"), "shingles")
    valid = described.where("digest is not null and id is not null")
    classes = stored(valid.groupBy("digest").agg(F.min("id").alias("cls"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes").select("cls", "n", "sig", "digest")
    at_class = classes.select("cls", "n", "sig")
    twice = valid.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id")
    same_key = spark.createDataFrame([], "a long, b long")
    if twice.take(1):
        same_key = cut(valid.join(twice, "id", "left_semi").join(classes.select("digest", "cls"), "digest").select(F.col("id").alias("a"), F.col("cls").alias("b")))

    roots = at_class.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(trees).cast("long"))).alias("node"), "cls", "sig")
    level = roots.mapInArrow(_branch(threshold, 1, seed), "node long, cls long").withColumn("comp", F.col("cls"))
    comps, texts = same_key.select(F.col("a").alias("node"), F.col("b").alias("component")), None
    for depth in range(rounds):
        nodes = level.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("node", "size")
        live = stored(level.join(nodes, "node").join(at_class, "cls").select("node", "cls", "comp", "n", "sig", "size"), f"nodes{depth}")
        if texts is None:
            wanted = live.select(F.col("cls").alias("id")).distinct()
            packed = rows.where("id is not null").mapInArrow(by_batch(_squeeze), "id long, text binary")
            texts = stored(packed.join(wanted, "id", "left_semi").distinct().select(F.col("id").alias("cls"), "text"), "texts")
        groups = live.where(F.col("size") <= small).groupBy("node").agg(F.collect_list(F.struct("cls", "comp", "n", "sig")).alias("members"))
        pairs = groups.where(F.size("members") > 1).select("members").mapInArrow(_pairs_in_node(floor, threshold), "a long, b long")
        large = live.where(F.col("size") > small)
        more = bool(large.take(1))
        if more:
            pairs = pairs.union(_star_pairs(large, floor))
        pairs = stored(pairs.distinct(), f"pairs{depth}")
        comps = _verified(pairs, texts, comps, words, percent)
        if not more:
            break
        left = large.select("node", "cls", "n", "sig").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
        mixed = left.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("node")
        if depth == rounds - 1:
            links = _links_in_large(left.join(mixed, "node"), texts, words, percent, block)
            comps = _with_links(comps, links) if links.take(1) else comps
            break
        level = left.join(mixed, "node").select("node", "cls", "sig").mapInArrow(_branch(threshold, 3, seed + depth + 1), "node long, cls long")
        level = cut(level.distinct().join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("node", "cls", F.coalesce("component", "cls").alias("comp")))

    reach = comps.withColumnRenamed("node", "cls")
    of_class = classes.select("digest", "cls").join(reach, "cls", "left").select("digest", F.coalesce("component", "cls").alias("c"))
    out = described.select("id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links_in_large(left: DataFrame, texts: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Confirmed links (a, b) between the components of large nodes, from (node, cls, n, comp).

    A node's largest component is cut into blocks, and so is the rest of the
    node. Every block of the rest meets every other block in a task of its own;
    blocks of the largest component do not meet each other.
    """
    by_comp = left.groupBy("node", "comp").agg(F.sum("n").alias("n"))
    sides = by_comp.groupBy("node").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("all"))
    sides = sides.select("node", "main", F.ceil((F.col("all") - F.col("in_main")) / block).cast("int").alias("rest"), F.ceil(F.col("in_main") / block).cast("int").alias("mains"))
    is_main = F.col("comp") == F.col("main")
    deal = F.pmod(F.xxhash64("cls", "node"), F.when(is_main, F.col("mains")).otherwise(F.col("rest"))).cast("int")
    dealt = left.select("node", "cls", "comp").join(sides, "node").withColumn("own", deal + F.when(is_main, F.col("rest")).otherwise(0))
    meets = F.sequence(F.lit(0), F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)
    met = dealt.withColumn("with", F.explode(meets)).select("node", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "cls", "comp", "own")
    blocks = met.join(texts, "cls").groupBy("node", "x", "y").agg(F.collect_list(F.struct("cls", "comp", "own", "text")).alias("members"))
    work = blocks.where(F.size("members") > 1).select((F.col("x") != F.col("y")).alias("cross"), "members")
    return cut(work.mapInArrow(_joined_in_blocks(words, percent), "a long, b long").distinct())


def _with_links(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) of all nodes but the smallest of each, with the links added."""
    return parents(links.union(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _star_pairs(large: DataFrame, floor: float, pivots: int = 24) -> DataFrame:
    """Pairs of the members of large nodes with about ``pivots`` of them, and with the two most central ones.

    The trees bring the same members together again, and a member that is linked
    in one node is linked; so each takes part in the largest of its nodes alone,
    one row a member however many trees there are. What it misses in the others
    stays for their branches.
    """
    one = large.groupBy("cls").agg(F.max(F.struct("size", "node")).alias("at"), F.first("sig").alias("sig")).select("at.node", "cls", "sig")
    one = cut(one)
    size = one.groupBy("node").agg(F.count("*").alias("size"))
    share = F.xxhash64("cls").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    some = one.join(size, "node").where(share < float(pivots) / F.col("size")).groupBy("node").agg(F.collect_list(F.struct("cls", "sig")).alias("pivots"))
    schema = "node long, cls long, mean double, near array<long>"
    first = cut(one.join(some, "node").select("node", "cls", "sig", "pivots").mapInArrow(_star(floor), schema))
    top = first.groupBy("node").agg(F.max(F.struct("mean", "cls")).alias("m"), F.min_by("cls", F.struct(-F.col("mean"), F.xxhash64("cls"))).alias("other"))
    central = top.select("node", F.explode(F.array_distinct(F.array("m.cls", "other"))).alias("cls"))
    best = central.join(one, ["node", "cls"]).groupBy("node").agg(F.collect_list(F.struct("cls", "sig")).alias("pivots"))
    second = one.join(best, "node").select("node", "cls", "sig", "pivots").mapInArrow(_star(floor), schema)
    near = first.union(second).select("cls", F.explode("near").alias("p"))
    return near.select(F.least("cls", "p").alias("a"), F.greatest("cls", "p").alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame, comps: DataFrame, words: int, percent: int) -> DataFrame:
    """Components (node, component) with the confirmed pairs: first each document's pair with its least partner, then those that would still join two."""
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    comps = _with_links(comps, confirm_links(first, texts, words=words, percent=percent))
    side = {s: comps.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab"}
    others = pairs.join(first.withColumnRenamed("a", "least"), "b").where("a <> least")
    apart = others.join(side["b"], "b", "left").join(side["a"], "a", "left")
    rest = cut(apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    if not rest.take(1):
        return comps
    found = cut(confirm_links(rest, texts, words=words, percent=percent))
    return _with_links(comps, found) if found.take(1) else comps


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
