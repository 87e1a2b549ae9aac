import random

import corpus_pipeline as cp


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "li", "mo", "te") for b in ("ra", "ni", "su", "do", "pe")]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choice(words) for _ in range(60)), rng.choice(["en", "de"]), f"src{i % 7}", 0))
    rows += [(200, rows[3][1], "en", "src1", 0), (201, rows[3][1] + " end", "en", "src1", 0), (202, "12 34", "en", "src0", 0), (203, None, None, None, None), (204, "write to me@x.org " + rows[5][1][:60], "en", "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    docs, seen = cp.table(spark, f"file://{tmp_path}", "documents"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        if name != "bpe":
            assert out.columns == docs.columns
        docs = cp.stored(out, name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert 202 not in seen["language_id"] and 203 not in seen["language_id"] and 3 in seen["language_id"]
    assert len(seen["language_id"]) == len(rows) - 2
    assert {200, 201} & set(seen["minhash_dedup"]) == set() and len(seen["minhash_dedup"]) == len(seen["language_id"]) - 2
    assert "<EMAIL>" in seen["pii"][204].text and seen["pii"][1].text == rows[1][1]
    assert 0 < len(seen["mixing"]) < len(seen["pii"]) and set(seen["mixing"]) <= set(seen["pii"])
    assert set(seen["bpe"]) == set(seen["mixing"]) and all(len(r.ids) == r.n_tokens > 0 for r in seen["bpe"].values())
    again = {r.doc_id: r.ids for r in cp.run(spark, f"file://{tmp_path}").collect()}
    assert again == {k: r.ids for k, r in seen["bpe"].items()}
