import random
from collections import Counter, defaultdict

import numpy as np

from spanloom.llm import components, embeddings, minhash
from spanloom.operators import components as operators_components


def _roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _sets(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def _links(sets, percent):
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    shared = Counter((a, b) for ids in where.values() for k, b in enumerate(ids) for a in ids[:k])
    return [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (20, 11), (11, 15), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 11: 11, 15: 11, 20: 11}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r[1] for r in components.components(chain).collect()} == {0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_odd_graphs_in_few_shuffles(spark):
    rng = random.Random(4)
    graphs = [[(rng.randrange(600), rng.randrange(600)) for _ in range(n)] for n in (100, 300, 700)]
    graphs += [[(999, i) for i in range(400)], [(0, i) for i in range(1, 400)] * 2, [(i, (i * 7 + 1) % 500) for i in range(500)]]
    for links in graphs:
        edges = spark.createDataFrame(links, "a long, b long").repartition(7)
        root = _roots(1000, links)
        for block in (10, 250_000):
            got = components.parents(edges, block=block).collect()
            assert sorted(map(tuple, got)) == [(i, r) for i, r in enumerate(root) if i != r]
    plan = operators_components._star_steps(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


def test_minhash_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    texts = []
    for _ in range(150):  # a group above the limit of small nodes
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    for _ in range(40):  # a chain: each copy edits the one before
        t = texts[-1].split() if len(texts) > 150 else [rng.choice(words) for _ in range(150)]
        t[rng.randrange(len(t))] = "new%d" % len(texts)
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    texts += [None, "", " \n\t", "One two", "one  TWO", "É one", "é one", texts[0], texts[160]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("text", "body")
    got = minhash.near_duplicates(rows.selectExpr("doc_id", "body", "1 as comp", "2 as sig"), text="body").toPandas().sort_values("doc_id")
    sets = _sets(texts)
    want = _roots(len(texts), _links(sets, 85))
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == want
    assert got.kept.tolist() == [i == c for i, c in enumerate(want)]


def test_minhash_empty_and_odd_rows(spark):
    none = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0
    odd = minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "a b")], "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in odd.collect()) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 400)] + 0.2 * rng.standard_normal((400, 16))
    x[300:] = centres[0] + 0.02 * rng.standard_normal((100, 16))
    x[310:340] = x[309]
    labels = [int(v) if v < 3 else None for v in rng.integers(0, 4, 400)]
    labels[300:] = [1] * 100
    rows = [(i, [float(np.float32(v)) for v in x[i]], labels[i]) for i in range(400)]
    rows[3] = (3, None, 1)
    rows[4] = (4, [0.0] * 16, 1)
    rows[5] = (5, [float("nan")] * 16, 1)
    rows[6] = (6, [None] * 16, 1)
    rows[7] = (7, [], 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df, block=32).toPandas().sort_values("vec_id")
    y = np.array([np.full(16, np.nan) if i in (3, 4, 5, 6, 7) else rows[i][1] for i in range(400)])
    norm = np.linalg.norm(y, axis=1)
    near = (y @ y.T) / np.outer(norm, norm) >= 0.93
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    near &= same
    np.fill_diagonal(near, False)
    missed = int(near.sum()) - int(got.n_links.sum())
    assert 0 <= missed <= 0.02 * near.sum()
    if not missed:
        assert got.component_id.tolist() == _roots(400, zip(*np.nonzero(near)))
    assert (got.n_links.to_numpy() <= near.sum(1)).all()
    assert embeddings.near_duplicates(df.where("false")).count() == 0
