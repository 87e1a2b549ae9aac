"""The prefix trie against a plain count of prefixes."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from spanloom.llm import tries
from spanloom.llm.tries import SIZE, ZFastTrie, op13_prefix_trie, prefix_trie, rebuilt, two_fattest


def plain(sequences):
    """Rows of all nodes of {conv_id: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in sequences.items():
        ends.setdefault(tuple(turns), []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {}
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below.get(p, ())) or 1
        saved[p] = sum(saved[q] for q in below.get(p, ())) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, ())), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest())
        for p, m in members.items()
    )


def plain_rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            assert two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


def path_of(turns):
    path, chars = [], []
    for t in turns:
        path.append(hashlib.sha256((path[-1] if path else b"") + t.encode()).digest()[:SIZE])
        chars.append(len(t).to_bytes(8, "little"))
    return b"".join(path), b"".join(chars)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=12), min_size=1, max_size=25), st.integers(1, 9))
def test_z_fast_trie(sequences, size):
    trie, rows = ZFastTrie(), [(i, *path_of(s), 1) for i, s in enumerate(sequences)]
    for i in range(0, len(rows), size):
        trie.insert(rows[i : i + size])
    for i, path, _, _ in rows:  # the exit node of what was inserted is its end
        assert trie.exit_node(path).depth * SIZE == len(path)
    want = {}
    for i, path, _, _ in rows:
        for d in range(0, len(path) + 1, SIZE):
            n, least = want.get(path[max(0, d - SIZE) : d], (0, i))
            want[path[max(0, d - SIZE) : d]] = n + 1, least
    assert {x[0]: (x[5], x[4]) for x in trie.expanded()} == want


def test_random_conversations(spark):
    rnd = random.Random(4)
    rows = [(c * rnd.choice((1, 1, 7)), t, rnd.choice(("user", None)), rnd.choice(("x", "hello", "", None, "é😀"))) for c in range(150, 420) for t in rnd.sample([None, 0, 1, 2, 3, 5, 8, 13], rnd.randint(1, 8))]
    rows += [(300, t, "user", "same") for t in range(20, 90)] + [(None, 1, "user", "nobody")] + [(200, 1, "user", "x")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert result(prefix_trie(rebuilt(df))) == plain(plain_rebuilt(rows))


def test_copies_and_small_tries(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 7)
    monkeypatch.setattr(tries, "TRIE_BYTES", 2_000)
    rows = [(c, t, "user", "copy" if c % 3 == 0 else f"{c % 40} {t}") for c in range(400) for t in range(c % 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert result(prefix_trie(rebuilt(df))) == plain(plain_rebuilt(rows))


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert result(prefix_trie(rebuilt(empty))) == []
    rows = [(1, 0, None, None), (2, 0, "", ""), (101, None, "user", "é")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn int, role string, text string, digest string, depth int")
    assert result(prefix_trie(rebuilt(df))) == plain(plain_rebuilt(rows))


def test_turnless(spark):
    told = spark.createDataFrame([(5, -1, None, 0), (9, -1, None, 0)], "conv_id long, place int, digest binary, n long")
    assert [tuple(r)[:7] for r in prefix_trie(told).collect()] == [(5, 0, None, 2, 0, 1, 0)]


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op13(spark, d):
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op13_prefix_trie(spark, d)) == plain(plain_rebuilt(rows))
