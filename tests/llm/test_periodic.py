"""Periodic runs against all lags of all words."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from spanloom.llm.periodic import op12_periodic_runs, runs_of, with_runs


def plain(words, least=6, periods=4):
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, periods * q):
                part = words[i - q : j]
                if not any(all(part[k] == part[k - r] for k in range(r, length)) for r in range(1, q)):
                    out.append((i - q, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def rewritten(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = rewritten(doc_id, re.findall("[^\x20\x09-\x0d]+", text or ""))
    runs = plain(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = best and 1000 * best[1] // best[2]
    return (len(runs), *(best or (None,) * 3), milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_small_alphabets():
    rnd = random.Random(3)
    for _ in range(1500):
        docs = []
        for _ in range(rnd.randint(1, 4)):
            words = []
            while len(words) < rnd.randint(0, 60):
                block = [rnd.randint(0, rnd.choice((1, 3, 9))) for _ in range(rnd.randint(1, 9))]
                words += (block * rnd.randint(1, 7))[: rnd.randint(1, 50)]
            docs.append(words)
        starts = np.cumsum([0, *map(len, docs)])
        got = runs_of(np.array([w for d in docs for w in d], dtype="i4"), starts)
        want = [(s + int(a), n, q) for a, d in zip(starts, docs) for s, n, q in plain(d)]
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2])), docs


def test_tables(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n ", "c"), (4, "no no no no no no", "d"), (4, "no no no no no no", "d"), (None, "a b " * 10, None), (5, "x\x85y\x1cz " * 9, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = {(r.doc_id, r.text): r for r in with_runs(docs).collect()}
    assert len(with_runs(docs).collect()) == len(rows) and with_runs(docs.limit(0)).count() == 0
    for (_, text), r in got.items():
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == plain(words)
    assert got[4, "no no no no no no"].collapsed == "no" and got[4, "no no no no no no"].start == "d" and got[1, None].collapsed == ""
    with pytest.raises(ValueError):
        with_runs(docs.withColumnRenamed("start", "runs"))
    with pytest.raises(ValueError):
        with_runs(docs, periods=2)


def test_long_text_of_frequent_words(spark):
    rnd = random.Random(9)
    words = [rnd.choice("abc") for _ in range(60_000)]
    words[20_000:50_000] = (words[20_000:27_000] * 5)[:30_000]
    r = with_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    long = [x for x in r.runs if x.period == 7_000]
    assert len(long) == 1 and long[0].start <= 20_000 and long[0].start + long[0].length >= 50_000


def test_op12(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("length(text) < 6000").select("doc_id", "text")
    more = spark.createDataFrame([(i, "w" * (i % 3) + " tick tock" * (i % 40)) for i in range(900_000, 900_120)] + [(900_500, None)], docs.schema)
    docs.union(more).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == docs.count() + 121
    texts = {r.doc_id: r.text for r in docs.union(more).collect()}
    for r in got:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(r.doc_id, texts[r.doc_id]), r.doc_id
    assert sum(r.n_runs > 0 for r in got) > 20
