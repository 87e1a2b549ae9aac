"""Prefix trie of conversations, built from z-fast tries.

The prefixes of a conversation are named by a chain of 128-bit digests, a turn
after the other, so a prefix is the same in all conversations and tasks. Distinct
conversations are dealt over tasks in the order of their paths, so that neighbours
in the trie meet; each task inserts its own, batch by batch, into a z-fast trie:
compacted nodes in a hash table, each under the prefix at the depth of its edge
that is divisible by the greatest power of two. The exit node of a conversation is
found by fat binary search, in a number of steps logarithmic in its turns. The
edges are then expanded into their nodes, and nodes of several tasks added up: no
result depends on how conversations are dealt, so neither a common first turn nor
a crowd of copies needs a task of its own, and a trie that has grown large is
given out and begun anew.

Sums over subtrees need no walk: of the conversations through a node the smallest
owns it, so each conversation owns the lower end of its path, and adds what it
owns to the nodes above once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import partitions, stored, table

SIZE = 16  # bytes of a prefix's name; the root's is empty
CHUNK = 4096  # ids joined at once
TRIE_BYTES = 64 << 20  # of paths in a task's trie before it is given out
NODE = "node binary, parent binary, depth long, chars long, conv_id long, n_convs long"


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the greatest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node: its edge runs from depth ``top`` (outside) to ``depth`` on the path of a conversation through it."""

    __slots__ = ("path", "chars", "top", "depth", "ends", "conv", "below")

    def __init__(self, path: bytes, chars: bytes, top: int, depth: int):
        self.path, self.chars, self.top, self.depth = path, chars, top, depth
        self.ends, self.conv = 0, None
        self.below: dict[bytes, Node] = {}

    def handle(self) -> bytes:
        return name(self.path, two_fattest(self.top, self.depth))


def name(path: bytes, depth: int) -> bytes:
    """The name of the prefix of ``depth`` turns."""
    return path[SIZE * (depth - 1) : SIZE * depth]


class ZFastTrie:
    def __init__(self) -> None:
        self.root = Node(b"", b"", 0, 0)
        self.handles: dict[bytes, Node] = {}
        self.bytes = 0

    def exit_node(self, path: bytes, start: Node | None = None) -> Node:
        """The deepest node whose edge the path enters, or the root; ``start`` is a node that lies on the path."""
        last = start or self.root
        low, high = last.depth, len(path) // SIZE
        while low < high:
            f = two_fattest(low, high)
            node = self.handles.get(name(path, f))
            if node is None:
                high = f - 1
            elif node.depth * SIZE <= len(path) and name(path, node.depth) == name(node.path, node.depth):
                low, last = node.depth, node
            else:
                return node
        return last.below.get(name(path, last.depth + 1), last) if last.depth * SIZE < len(path) else last

    def insert(self, rows: list[tuple[int, bytes, bytes, int]]) -> None:
        """A batch of (conv_id, path, chars, number of conversations that end there): exits are found for all, and each exit's rows follow each other."""
        found = [(self.exit_node(row[1]), row) for row in rows]
        found.sort(key=lambda x: (x[0].path[: SIZE * x[0].depth], x[0].depth, x[1][1]))
        for _, (conv, path, chars, ends) in found:
            self._add(self.exit_node(path), conv, path, chars, ends)

    def _add(self, node: Node, conv: int, path: bytes, chars: bytes, ends: int) -> None:
        turns = len(path) // SIZE
        low, high = node.top, min(node.depth, turns)
        while low < high:  # how far the path follows the edge
            mid = (low + high + 1) // 2
            if name(path, mid) == name(node.path, mid):
                low = mid
            else:
                high = mid - 1
        if low < node.depth:
            node = self._split(node, low)
        if turns > node.depth:
            leaf = node.below[name(path, node.depth + 1)] = Node(path, chars, node.depth, turns)
            self.handles[leaf.handle()] = node = leaf
            self.bytes += len(path) + len(chars) + 500
        node.ends += ends
        node.conv = conv if node.conv is None else min(node.conv, conv)

    def _split(self, node: Node, depth: int) -> Node:
        above = self.root
        if node.top:
            above = self.exit_node(node.path[: SIZE * node.top])
        upper = Node(node.path, node.chars, node.top, depth)
        del self.handles[node.handle()]
        node.top = depth
        upper.below[name(node.path, depth + 1)] = node
        above.below[name(node.path, upper.top + 1)] = upper
        self.handles[node.handle()], self.handles[upper.handle()] = node, upper
        return upper

    def expanded(self) -> Iterator[tuple[bytes, bytes | None, int, int, int, int]]:
        """(node, parent, depth, chars, smallest conversation, conversations) of all prefixes."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.below.values())
        for node in reversed(order):  # children come before their parents
            for child in node.below.values():
                node.ends += child.ends
                node.conv = child.conv if node.conv is None else min(node.conv, child.conv)
            if node is self.root:
                yield b"", None, 0, 0, node.conv, node.ends
            chars = np.frombuffer(node.chars, "<i8")
            for d in range(node.top + 1, node.depth + 1):
                yield name(node.path, d), name(node.path, d - 1) if d > 1 else b"", d, int(chars[d - 1]), node.conv, node.ends


def _local_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, kinds = ZFastTrie(), [pa.binary(), pa.binary(), *[pa.int64()] * 4]
    names = ["node", "parent", "depth", "chars", "conv_id", "n_convs"]

    def given_out() -> Iterator[pa.RecordBatch]:
        rows = []
        for row in trie.expanded():
            rows.append(row)
            if len(rows) == CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    some = False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "path", "chars", "n_ends")]
        for i in range(0, batch.num_rows, CHUNK):
            trie.insert(list(zip(*(c[i : i + CHUNK] for c in columns))))
            some = True
            if trie.bytes > TRIE_BYTES:
                yield from given_out()
                trie, some = ZFastTrie(), False
    if some:
        yield from given_out()


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to (conv_id, path, chars): the names of all prefixes and the code points of their last turns. Rows without a digest only tell that there is a conversation."""
    conv, path, chars = None, [], []
    out: list[tuple[int, bytes, bytes]] = []

    def close() -> None:
        if conv is not None:
            out.append((conv, b"".join(path), np.array(chars, "<i8").tobytes()))

    def packed() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "path", "chars"])
        out.clear()
        return batch

    for batch in batches:
        for c, digest, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "digest", "n"))):
            if c != conv:
                close()
                conv, path, chars = c, [], []
                if len(out) >= CHUNK:
                    yield packed()
            if digest is not None:
                path.append(hashlib.sha256((path[-1] if path else b"") + digest).digest()[:SIZE])
                chars.append(n)
    close()
    if out:
        yield packed()


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) to (node, conv_id, ids, n): stretches of at most CHUNK ids, joined by commas, under the first of them."""
    node, ids = None, []
    out: list[tuple[bytes, int, str, int]] = []

    def packed() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["node", "conv_id", "ids", "n"])
        out.clear()
        return batch

    for batch in batches:
        for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if key != node or len(ids) == CHUNK:
                if ids:
                    out.append((node, ids[0], ",".join(map(str, ids)), len(ids)))
                node, ids = key, []
                if len(out) >= CHUNK // 4:
                    yield packed()
            ids.append(conv)
    if ids:
        out.append((node, ids[0], ",".join(map(str, ids)), len(ids)))
    if out:
        yield packed()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches of ids to (node, conv_id, n_ends, ends_sha256), one stretch in memory at a time."""
    node, first, n, digest = None, None, 0, None
    out: list[tuple[bytes, int, int, str]] = []

    def packed() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["node", "conv_id", "n_ends", "ends_sha256"])
        out.clear()
        return batch

    for batch in batches:
        for key, conv, ids, more in zip(*(batch.column(c).to_pylist() for c in ("node", "conv_id", "ids", "n"))):
            if key != node:
                if digest is not None:
                    out.append((node, first, n, digest.hexdigest()))
                    if len(out) >= CHUNK:
                        yield packed()
                node, first, n, digest = key, conv, 0, hashlib.sha256()
            digest.update(("," if n else "").encode() + ids.encode())
            n += more
    if digest is not None:
        out.append((node, first, n, digest.hexdigest()))
    if out:
        yield packed()


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations, given as (conv_id, place, digest, n): turns in order of place, 16 or more bytes that tell a turn's content, and its code points.

    A row without a digest tells of a conversation that may have no turns. Returns
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256). No conversations give no nodes, not even a root. Conversations
    are held as one row each, 24 bytes a turn.
    """
    spark, n = turns.sparkSession, partitions(turns.sparkSession)
    rows = turns.select("conv_id", "place", "digest", F.col("n").cast("long").alias("n")).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("digest").isNotNull(), "place")
    paths = stored(rows.mapInArrow(_paths, "conv_id long, path binary, chars binary"), "paths")
    last = F.expr(f"substring(path, greatest(1, octet_length(path) - {SIZE - 1}), {SIZE})")
    ids = paths.select(last.alias("node"), "conv_id").repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined_ids, "node binary, conv_id long, ids string, n long")
    ends = stored(ids.repartition(n, "node").sortWithinPartitions("node", "conv_id").mapInArrow(_ends, "node binary, conv_id long, n_ends long, ends_sha256 string"), "ends")

    distinct = paths.join(ends.select("conv_id", "n_ends"), "conv_id")
    dealt = distinct.repartitionByRange(n, F.expr(f"substring(path, 1, {16 * SIZE})"), "conv_id")
    added = dealt.mapInArrow(_local_tries, NODE).groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")
    )
    own = F.sum((F.col("n_convs") - 1) * F.col("chars")).over(Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0))
    leaf = F.max(F.coalesce(F.col("n_convs") == F.col("n_ends"), F.lit(False)).cast("long")).over(Window.partitionBy("conv_id"))
    lowest = F.max("depth").over(Window.partitionBy("conv_id"))
    highest = F.min("depth").over(Window.partitionBy("conv_id"))
    nodes = added.join(ends.select("node", "n_ends", "ends_sha256"), "node", "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", "ends_sha256", own.alias("own"), leaf.alias("leaf"), (lowest > F.col("depth")).cast("long").alias("goes_on"), (highest == F.col("depth")).alias("first")
    )
    nodes = stored(nodes, "nodes")

    owners = nodes.where("first and depth > 0")
    above = owners.join(distinct.select("conv_id", "path"), "conv_id").select("own", "leaf", (F.col("depth") - 1).alias("top"), "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth") - 1)).alias("d"))
    at = F.expr(f"CASE WHEN d = 0 THEN X'' ELSE substring(path, cast({SIZE} * (d - 1) + 1 as int), {SIZE}) END")
    more = above.groupBy(at.alias("node")).agg(F.sum("own").alias("m_own"), F.sum("leaf").alias("m_leaf"), F.count_if(F.col("d") == F.col("top")).alias("m_kids"))

    # every node but an owner's first has its owner's parent; the root's owner is one row
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("root_conv"))
    at_root = owners.where("depth = 1").select("conv_id").crossJoin(F.broadcast(root)).select("conv_id", F.col("root_conv").alias("parent_conv"))
    deeper = owners.where("depth > 1").select("conv_id", "parent").join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv")), "parent").select("conv_id", "parent_conv")
    parents = at_root.union(deeper).withColumn("first", F.lit(True))
    full = nodes.join(more, "node", "left").join(parents, ["conv_id", "first"], "left")
    zero = F.lit(0).cast("long")
    return full.select(
        "conv_id", "depth", F.when(F.col("depth") == 0, None).when(F.col("first"), F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (F.col("goes_on") + F.coalesce("m_kids", zero)).alias("n_children"), (F.col("leaf") + F.coalesce("m_leaf", zero)).alias("n_leaves"), (F.col("own") + F.coalesce("m_own", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with digest and n: what tells a turn's role and text, and the text's code points. Null role and text count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return turns.withColumn("digest", F.unhex(told)).withColumn("n", F.length(text).cast("long"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The query's conversations, as prefix_trie takes them: the first h turns of the conversation at the last hundred, then a conversation's own after its first h.

    Turns go by turn (null first), then role and text; repeated rows are turns
    each. Rows without a conv_id belong to no conversation.
    """
    rows = digested(conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h")
    turns = stored(rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "digest", "n"), "turns")
    own = turns.select("conv_id", "pos", "digest", "n", h)
    after = own.where("pos >= h").select("conv_id", (F.col("pos") + 6).alias("place"), "digest", "n")
    each = own.select("conv_id", "h").distinct()
    heads = turns.where("conv_id % 100 = 0 and pos < 5").select(F.col("conv_id").alias("base"), F.col("pos").alias("place"), "digest", "n")
    first = each.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base").where("place < h").select("conv_id", "place", "digest", "n")
    told = each.select("conv_id", F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n"))
    return told.union(first).union(after)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
