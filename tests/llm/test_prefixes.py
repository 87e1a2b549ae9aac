"""Prefix counts against the library, prefix by prefix."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from spanloom.llm import prefixes
from spanloom.llm.prefixes import PrefixCounter, changes, fitting_chars, prefix_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, COUNTER = Tokenizer.from_file(PATH), PrefixCounter(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def check(text):
    assert changes(COUNTER.deltas(text)).cumsum().tolist() == [library(text[: i + 1]) for i in range(len(text))], text


@pytest.mark.parametrize(
    "text",
    ["", " ", "hello world", "it's they're I'll we'd 'r 're're'", "a!!<|startoftext|>b <|endoftext|><|endof", "<|startoftext|><|startoftext|>", "Café Ǻx ≠= 한", "İstanbul ΑΣ", "a" * 50,
     "x  y\u0085z\u001cq", "日本語のテキスト 12345 ½²", "é" * 40, "́́á̧b", "'ś '́s ''s !'s", "ཱི̈́x", "<|STARTOFTEXT|>"],
)
def test_every_prefix_of_hard_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeinorstvlm  \n\t\x1c\x7f\x85\xa0.!<|>0129éÉß̧́̈가각ΣσİıǄ日ーが゙ऩक̈́'😀"), max_size=30))
def test_every_prefix_of_any_text(text):
    check(text.replace("<", "<|endoftext|>", 1) if len(text) % 3 == 0 else text)


def test_every_prefix_of_words_that_share_beginnings():
    rnd = random.Random(5)
    for _ in range(50):
        check(" ".join("".join(rnd.choice(("th", "er", "ing", "é", "ou", "st", "an")) for _ in range(rnd.randint(1, 12))) for _ in range(8)))


def test_states_are_forgotten_without_effect():
    small = PrefixCounter(PATH, most=3)
    small.merges.most = 5
    for text in ("the thing they thought", "other mothers' brothers", "the thing they thought"):
        assert small.deltas(text) == COUNTER.deltas(text)


def test_counts_too_wide_for_a_byte(monkeypatch):
    real = prefixes._differences
    monkeypatch.setattr(prefixes, "_differences", lambda counts: real([n * 200 for n in counts]))
    counter = PrefixCounter(PATH)
    text = "the thing's\n  é"
    stored = counter.deltas(text)
    assert stored[0] == 4 and changes(stored).tolist() == changes(COUNTER.deltas(text)).tolist()


def test_answers():
    text = "an internationalisation of words"
    stored = COUNTER.deltas(text)
    for chars in range(len(text) + 2):
        assert prefix_tokens(stored, chars) == library(text[:chars])
    for limit in range(12):
        assert fitting_chars(stored, limit) == max(i for i in range(len(text) + 1) if library(text[:i]) <= limit)


def test_tables(spark):
    long = "wörd " * 60_000 + "x" * 5_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "two words", "c"), (3, "two words", "c"), (4, long, None), (None, "no key", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    got = prefixes.with_answers(prefixes.with_prefix_counts(docs, PATH), 2).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), b, library(t or ""), library(t or "") > 2) for i, t, b in rows)
    assert prefixes.with_prefix_counts(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        prefixes.with_prefix_counts(docs.withColumnRenamed("n_bytes", "prefix_counts"), PATH)
    with pytest.raises(ValueError):
        prefixes.with_answers(prefixes.with_prefix_counts(docs.withColumnRenamed("n_bytes", "n_tokens"), PATH), 2)
    cut = {r.doc_id: r.text for r in prefixes.truncated(docs, PATH, 100).collect()}
    assert cut[1] is None and cut[3] == "two words" and library(cut[4]) <= 100 < library(long[: len(cut[4]) + 5])


def test_op11(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in prefixes.op11_token_counts(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        text, g = r.text or "", got[r.doc_id]
        n = library(text)
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len(text.encode()), n, n > 2048)
        assert (g.fit_chars == len(text)) if n <= 2048 else (library(text[: g.fit_chars]) <= 2048)
