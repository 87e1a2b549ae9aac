import hashlib
import html as html_lib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, fingerprints, html, langid, mixing, pii, repeats, tokenstore
from spanloom.llm.suffixes import suffix_order

POOL = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "漢", "字", "😀", "1", "23", "'s", "'ll", "!", "...", "\x1c", "\x85", "\xa0", "²", "½", "the", "ing", "​", "ﬁ", "_", "<|endoftext|>"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n, seed=1, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(library):
    ranks, enc = library
    codec = bpe.Codec(ranks, P.PATTERN)
    for t in [*texts(3000), "ab" * 20000 + "thethe" * 3000, ""]:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert "".join(codec.decode(ids)) == t
    small = bpe.Transducer(ranks, max_states=50)  # states are forgotten on the way, within long pieces too
    word = "".join(random.Random(2).choice("etaoinsh") for _ in range(9000))
    assert small.encode(word.encode()) == enc.encode_ordinary(word)
    parts = list(small.stream(word.encode(), every=64))
    assert len(parts) > 50 and sum(parts, []) == enc.encode_ordinary(word)


def test_utf8_stream():
    data = "é漢😀a".encode()
    assert "".join(bpe.utf8_stream(data[i : i + 1] for i in range(len(data)))) == "é漢😀a"
    assert "".join(bpe.utf8_stream([b"\xe6", b"a\xff"])) == "�a�"


def test_bpe_rows(spark, library):
    rows = [(1, "The cat", "en", "s", 7), (1, "The cat", "en", "s", 7), (2, None, None, None, None), (None, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("old"))
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_documents(df, path, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids) for r in out) == sorted((r[0] or 0, len(i), i) for r in rows for i in [library[1].encode_ordinary(r[1] or "")])
    assert bpe.encode_documents(df.where("false"), path, P.PATTERN).count() == 0


def test_token_store(spark, library):
    found = texts(300, 5)
    rows = [(i * 3, t) for i, t in enumerate(found)] + [(9, "twice"), (None, "no key"), (5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = tokenstore.new_path(spark, "tokens")
    tokenstore.write_store(df, path, P.path("byte_bpe_50k.json"), P.PATTERN, shards=4)
    got = tokenstore.look_up(df.select("doc_id"), path).collect()
    start, want = 0, []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library[1].encode_ordinary(t or ""), 2], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    missing = tokenstore.look_up(spark.createDataFrame([(1,), (7777,)], "doc_id long"), path)
    assert missing.count() == 0
    empty = tokenstore.new_path(spark, "tokens")
    tokenstore.write_store(df.where("false"), empty, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert tokenstore.look_up(df.select("doc_id"), empty).count() == 0


def test_token_store_query_keeps_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>\n", "<|endoftext| >", "", *texts(300, 9)]
    spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.op7_token_store(spark, str(tmp_path)).collect()}
    start = 0
    for k, t in enumerate(found):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert got[k] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert any("<|endoftext|>" in t for t in found[5:]) and len(got) == len(found)


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    slots = tokenstore.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_language(spark):
    rng = random.Random(4)
    words = {"xx": ["kalo", "mino", "tupa", "riko"], "yy": ["strengs", "brucht", "knoll", "pfing"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k, None, 0) for i, k in enumerate(["xx", "yy"] * 60)]
    rows += [(900, None, "xx", None, 0), (901, "", None, None, 0), (902, "12 34 !?", "yy", None, 0), (None, "kalo mino", "xx", None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("old"))
    profiles = langid.learn_profiles(df.where(~langid.is_held_out() & F.col("doc_id").isNotNull()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(df, profiles).collect()}
    assert all(got[r[0]][0] == r[2] and 0 <= got[r[0]][1] <= 1 for r in rows[:120])
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[None][0] == "xx"
    held = {r[0]: r[1] for r in df.select("doc_id", langid.is_held_out()).collect()}
    assert all(v == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) for k, v in held.items())
    assert langid.predict_language(df, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.predict_language(df.where("false"), profiles).count() == 0
    long = langid.gram_counts("ab " * 400_000)
    assert long[1].sum() > 2_000_000


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu one two</a></li></ul></nav><div class=\"ad\">Buy this thing right now</div>"
    "<article><h1>Head &amp; line</h1><p>First   para\nwith <b>bold</b> text.<br>More&nbsp;words here.<p>Second para.</p><form>name</form></article><div id=\"comments\"><p>Nice one, thanks for it</p></div><footer>&copy; host here</footer></body></html>"
)


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p></p>"), (5, "u", PAGE), (6, "u", "plain words only &lt;b&gt;"), (7, "u", "<div" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    weights = html.learn_weights(df)
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df, weights).collect()}
    want = "Head & line\nFirst para with bold text. More words here.\nSecond para."
    assert got[1] == got[5] == (want, len(want))
    assert got[2] == got[3] == got[4] == ("", 0) and got[6][0] == "plain words only <b>"
    assert html.Extractor({}).text(PAGE) == want
    assert html.extract(df.where("false"), weights).count() == 0 and html.learn_weights(df.where("false")) == {}


HEAD, TAIL = "<article><p>Words before the part at hand stand here, more of them than any tags of the part can outweigh.</p>", "<p>Words after the part at hand stand here too.</p></article>"


@pytest.mark.parametrize(
    "part, kept",
    [
        ('<svg class="icon"/>', ""),
        ('<svg><title/><path d="M0"/></svg>', ""),
        ("<svg><title>Name</title><g><svg/></g></svg>", ""),
        ('<object data="a.swf"/>', ""),
        ('<math xmlns="m"/>', ""),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "So x=2 holds."),
        ('<p class="notice">Buy now', ""),
        ('<ul><li class="share">Tell all<li>Item kept</ul>', "Item kept"),
        ("<section><aside>Aside text</section>", ""),
        ('<div><span class="share">Tell all</div>', ""),
        ("<table><tr><td class=ads>Buy<td>Cell kept</table>", "Cell kept"),
        ("<div><nav>Menu<div>More</div></nav></div>", ""),
        ('<p class="related-work">Related work is content.</p>', "Related work is content."),
    ],
)
def test_html_ends_of_parts(part, kept):
    want = [re.sub("<[^>]*>", "", HEAD), *([kept] if kept else []), re.sub("<[^>]*>", "", TAIL)]
    assert html.Extractor({}).text("<html><body>" + HEAD + part + TAIL + "</body></html>") == "\n".join(want)


LISTS = {
    "table": ("<table>" + "<tr><td>cell a</td><td>cell b</td></tr>" * 30 + "</table>", ["cell a", "cell b"] * 30),
    "list": ("<ul>" + "<li><a href=x>item</a></li>" * 30 + "</ul>", ["item"] * 30),
    "figures": ("<figure><img src=x><figcaption>seen</figcaption></figure>" * 20, ["seen"] * 20),
    "code": ("<pre>" + "<span>x</span> " * 60 + "</pre>", [" ".join(["x"] * 60)]),
    "unknown tags": ("<foo-bar><baz>thing</baz></foo-bar>" * 40, ["thing" * 40]),
    "empty markup": ("<div><span></span></div>" * 200, []),
}
SAID = "<p>reader says this and that</p>" * 12


@pytest.mark.parametrize("mark", ["article", "main"])
@pytest.mark.parametrize("name", LISTS)
def test_html_markup_never_ends_a_short_article(spark, mark, name):
    """Content of twenty words around much markup, with learned and with fixed scores, among menus and long comments that have no names of their own."""
    part, kept = LISTS[name]
    words = " ".join(["word"] * 10)
    page = (
        f"<html><head><title>T</title></head><body><nav><ul>{'<li><a href=x>menu</a></li>' * 40}</ul></nav><div class='cookie-bar'>{SAID}</div><{mark}><h1>{words}</h1>{part}<p>{words}</p></{mark}>"
        f"<div class='comment-list'>{SAID}</div><section id='user-comments'>{SAID}</section><footer>host</footer></body></html>"
    )
    want = "\n".join([words, *kept, words])
    learned = html.learn_weights(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")) if name == "table" else {}
    assert html.Extractor({}).text(page) == want and html.Extractor(learned).text(page) == want
    outside = page.replace("<footer>", f"<div>{'other text of the site ' * 30}</div><footer>")
    assert html.Extractor({}).text(outside) == want


def test_html_names_around_an_article():
    """A compound name ends like a part without content: what is in the article or main element that it holds stays, all else goes, however much it is."""
    body = "<p>words of the page at hand</p>"
    for name in ("page-sidebar", "site-menu", "with-comments"):
        assert html.Extractor({}).text(f"<body><div class='{name}'><p>aside</p><article>{body}</article></div></body>") == "words of the page at hand"
    assert html.Extractor({}).text(f"<body><div class='comment-list'>{SAID}</div>{body}</body>") == "words of the page at hand"
    assert html.Extractor({}).text(f"<body><div class='comment-list'>{SAID}</div></body>") == ""


def test_html_weights_of_what_stays_alone(spark):
    """Menus that are left out anyway do not count against lists, and unseen tags score as all tags together."""
    page = "<html><body><nav>" + "<ul><li><a>m</a></li></ul>" * 50 + "</nav><article><ul><li><a>one two</a></li></ul><p>three</p></article><div>host</div></body></html>"
    weights = html.learn_weights(spark.createDataFrame([(page,)], "html string"))
    assert weights["li"] == weights["a"] == weights["ul"] == -0.05 and weights["div"] < -0.6 and -6 <= weights["?"] <= -0.05 and weights["?"] != -1.0


def test_html_missing_end_tags():
    want = "Words before the part at hand stand here, more of them than any tags of the part can outweigh.\nWords after the part at hand stand here too."
    for top in ("<head><meta charset=x><body>", "<head><title>T</title>", "<head></head><body><nav><a href=x>Menu</a>", '<body><div class="sidebar">Side', "<body><aside><article>Other</article></aside>"):
        assert html.Extractor({}).text("<html>" + top + HEAD + TAIL) == want
    for page in ("<b><div>" * 20_000 + "</b>" * 20_000, "<nav>" * 50_000, "<p class=ad>" * 50_000, "<td>" * 50_000 + "</div>" * 50_000):
        assert html.Extractor({}).text(page) == ""


def test_fingerprints(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    found = [" ".join(word() for _ in range(rng.randint(20, 200))) for _ in range(40)]
    rows = [(i * 1000, t) for i, t in enumerate(found)] + [(5, None), (6, ""), (7, "x"), (8, found[0]), (None, "lone text"), (3_000_000_000, "é" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit(1)).withColumn("bucket", F.lit(1))
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(df, width=4).collect()}
    order = sorted([(k, t or "") for k, t in rows if k is not None], reverse=True)
    for i, (k, t) in enumerate(order):
        nxt, half = order[(i + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
        if edited == t:
            assert got[k].near_edited == 1 and got[k].fingerprint == got[k].edited_fingerprint
    assert got[8].fingerprint == got[0].fingerprint and got[None].n_chars == 9
    big = [got[k] for k, t in order if len(t) > 300]
    assert np.mean([r.near_edited for r in big]) > 0.05 > np.mean([r.near_next for r in big])
    assert fingerprints.fingerprint_edits(df.where("false")).count() == 0


def _spans(x):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii(spark):
    rng = random.Random(5)
    pool = ["a", "b1", ".", "@", "@", "-", "x.com", "1", "12", "255", "256", ".", "4111111111111111", " ", "+", "(", ")", "é", "4", "0", "\n", "9", "1.2.3.4", "+49 170 1234567", "a@b.co", "5500-0000-0000-0004"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(1500)] + [(9000, None), (9001, ""), (9002, "1" * 60000), (9003, "a" * 60000), (9004, "1 " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("t", F.lit(2)).withColumn("email", F.lit(3))
    got = {r.doc_id: r for r in pii.find_spans(df).collect()}
    for k, t in rows:
        if len(t or "") < 1000:
            want = _spans(t or "")
            joined = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
            assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (k, t)
            assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(w[0] == x for w in want) for x in pii.KINDS]
            assert set(joined.split(",")) - {""} <= set(got[k].spans.split(","))
    assert got[9002].spans == got[9003].spans == got[9004].spans == ""
    assert pii.find_spans(df.where("false")).count() == 0
    docs = spark.createDataFrame([(1, "mail me@x.org or 1.2.3.4 é", "en", "s", 0), (2, None, "en", "s", 0), (3, "clean", "en", "s", 5)], DOCS)
    assert {r.doc_id: (r.text, r.n_chars) for r in pii.mask(docs).collect()} == {1: ("mail <EMAIL> or <IP> é", 22), 2: (None, None), 3: ("clean", 5)}


def test_mixing_against_sql(spark):
    import duckdb

    rng = random.Random(7)
    rows = [(i if i % 50 else None, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))) if i % 17 else None, rng.choice(["en", "de", "fr", "es", None]), rng.choice(["src0"] * 5 + [f"src{k}" for k in range(9)] + [None, "odd"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n", F.lit(1)).withColumn("budget", F.lit(1))
    got = mixing.mix(df).select("doc_id", F.col("__source").alias("source"), F.col("__n").alias("n_tokens"), F.col("__epoch").cast("long").alias("epoch")).toPandas()
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toArrow())
    want = con.sql(mixing.SQL).df()[["doc_id", "source", "n_tokens", "epoch"]]
    key = lambda f: sorted(map(repr, f.astype({"n_tokens": int, "epoch": int}).assign(doc_id=f.doc_id.fillna(-1).astype(int)).itertuples(index=False, name=None)))
    assert key(got) == key(want) and len(got) > 300
    total = df.select(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    assert 0.5 * total < got.n_tokens.sum() <= 0.6 * total
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mix(df.where("text is null")).count() == 0


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(3000):
        t = [rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 40))]
        assert suffix_order(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats(spark, hot):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab c") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(300):
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(len(x))] = rng.choice("xyzé")
        a = rng.randrange(300)
        rows.append((i, "".join(x[a : a + rng.randint(0, 400)]) if rng.random() > 0.02 else None))
    rows += [(600, "a" * 3000), (601, "a" * 1000 + "b" + "a" * 100), (602, "ab" * 700), (603, "ba" * 300), (604, "abc" * 400 + "a" * 60), (605, "a" * 49), (606, "a" * 50), (606, base[0]), (None, base[0])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit(1)).repartition(5), hot=hot).collect()
    first = {}
    for k, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], k)
    want = []
    for k, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 49):
            if k is not None and first[b[i : i + 50]] < k:
                m[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        want.append((k, len(b), sum(m), spans, hashlib.sha256(bytes(c for c, f in zip(b, m) if not f)).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_of_a_hot_line(spark, monkeypatch):
    rng = random.Random(8)
    line = "This line of a licence stands in every document at hand. "
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, own() + line + own()) for i in range(400)]
    whole, hot = repeats._sort_suffixes, 50

    def watched():
        sort = whole()

        def run(batches):
            def seen():
                sizes = {}
                for batch in batches:
                    names = [n for n in batch.schema.names if n in ("anchor", "deal")]
                    for group in zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in names)):
                        sizes[group] = sizes.get(group, 0) + 1
                    yield batch
                assert max(sizes.values(), default=0) <= hot

            yield from sort(seen())

        return run

    monkeypatch.setattr(repeats, "_sort_suffixes", watched)
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), hot=hot).collect()}
    first = {}
    for k, t in rows:
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], k)
    for k, t in rows:
        m = [False] * len(t)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < k:
                m[i : i + 50] = [True] * 50
        assert got[k].n_removed == sum(m) and got[k].kept_sha256 == hashlib.sha256("".join(c for c, f in zip(t, m) if not f).encode()).hexdigest()
    assert got[0].n_removed == 0 and all(got[k].n_removed >= len(line) - 1 for k in range(1, 400))


def test_pages_against_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(60)
    got = {r.page_id: r.text for r in html.extract(pages, html.learn_weights(pages)).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def _sketch_by_hand(text):
    """The 64 sketches of a text of words of at most 12 characters, by plain counting."""
    import xxhash

    sign = lambda x: x - (1 << 64) if x >> 63 else x
    raw = lambda x: x & ((1 << 64) - 1)

    def strings(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed) if p is not None else seed
        return sign(seed)

    def numbers(*values):
        seed = 42
        for v, size in values:
            seed = xxhash.xxh64_intdigest(raw(v).to_bytes(8, "little")[:size], seed)
        return sign(seed)

    words = text.split()
    if not words:
        return [0] * 64
    seen, kept = {}, {}
    for i in range(max(1, len(words) - 2)):
        h = strings([words[i + k] if i + k < len(words) else None for k in range(3)]) >> 24
        n = seen[h] = seen.get(h, -1) + 1
        numbered = numbers((h, 8), (n, 4)) >> 24
        kept.setdefault((numbered >> 34) + 32, []).append((numbered, i))
    out = [0] * 64
    for bucket, found in kept.items():
        two = sorted(sorted(found)[:2], key=lambda x: x[1])
        out[bucket] = numbers(*((h, 8) for h, _ in two)) % 65535 + 1
    return out


def test_fingerprints_against_plain_counting(spark):
    rng = random.Random(16)
    found = [" ".join(rng.choice(["ab", "cd", "efg", "h", "ij"]) + str(rng.randrange(3)) for _ in range(rng.choice([0, 1, 2, 3, 9, 80, 400]))) for _ in range(40)]
    got = spark.createDataFrame(list(enumerate(found)), "i int, t string").select("i", fingerprints.sketches(F.col("t")).alias("s")).collect()
    assert {r.i: list(r.s) for r in got} == {i: _sketch_by_hand(t) for i, t in enumerate(found)}


def test_fingerprints_of_edits(spark):
    rng = random.Random(12)
    latin = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(6000))
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000))
    rows = [(x, y) for t in (latin, han) for x, y in ((t, "x" + t), (t, t[:5] + "q" + t[5:]), (t, t[: len(t) // 2] + t[len(t) // 2 + 1 :]), (t, t[::-1]))]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(fingerprints.likeness(fingerprints.sketches(F.col("a")), fingerprints.sketches(F.col("b")))).collect()]
    assert all(x > 0.85 for x in [*got[:3], *got[4:7]]) and got[3] < 0.1 and got[7] < 0.1
    far = [(k * 10**15 - 5 * 10**17, f"text {k} of them") for k in range(1000)]
    df = spark.createDataFrame(far, "doc_id long, text string")
    done = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_edits(df).collect()}
    order = sorted(far, reverse=True)
    for i, (k, t) in enumerate(order):
        n = len(t) // 2
        assert done[k] == hashlib.sha256((t[: len(t) - n] + order[(i + 1) % len(order)][1][:n]).encode()).hexdigest()


def test_language_steps_and_ranks():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("aB é.1 ") for _ in range(rng.randint(0, 40)))
        whole, parts = langid.gram_counts(t), langid.gram_counts(t, 3)
        assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
        low, n = re.sub(r"[^a-zé]+", " ", t.lower()).strip(), {}
        padded = f" {low} " if low else ""
        for size in (1, 2, 3):
            for i in range(len(padded) - size + 1):
                g = padded[i : i + size]
                if (size == 3 and g[1] != " ") or (size == 2 and g.strip()) or (size == 1 and g != " "):
                    n[g] = n.get(g, 0) + 1
        assert sorted(whole[1].tolist()) == sorted(n.values()), t
    profiles = {k: [int(x) for x in langid.top_grams(*langid.gram_counts(t), 400).view(np.int64)] for k, t in (("xx", "kalo mino tupa riko"), ("yy", "strengs brucht knoll"))}
    ranker = langid.Ranker(profiles, 300)
    for t in ("kalo tupa", "knoll strengs kalo", "zzz"):
        own, far = langid.top_grams(*langid.gram_counts(t), 300).view(np.int64).tolist(), max(map(len, profiles.values()))
        distance = {k: sum(min(abs(p.index(g) - i), far) if g in p else far for i, g in enumerate(own)) / (len(own) * far) for k, p in profiles.items()}
        best = min(profiles, key=lambda k: (distance[k], k))
        assert ranker.predict(t) == (best, 1 - distance[best])


@pytest.mark.parametrize("name, whole", [("page has-sidebar", True), ("layout no-ads", True), ("post social-post", True), ("content with-related", True), ("wrapper search-page", True), ("hasSidebar", True), ("sidebar-left", False), ("post-comments", False), ("adBox", False), ("related-posts", False)])
def test_html_class_names(name, whole):
    body = "<p>One two three four five six seven eight nine ten.</p><p>More words to read stand in this one.</p>"
    text = "One two three four five six seven eight nine ten.\nMore words to read stand in this one."
    part = f'<div class="{name}">{body}</div>'
    page = part if whole else f"<div>{body}{body}</div>{part}"
    assert html.Extractor({}).text(f"<html><body><nav><a>Menu</a></nav>{page}<footer>Host</footer></body></html>") == (text if whole else f"{text}\n{text}")


def test_html_of_long_broken_pages():
    import time

    start = time.perf_counter()
    for bad in ("<!" * 1_000_000, "<script" * 300_000, "<a '" * 300_000, "<" * 1_000_000):
        assert len(html.tokens(bad)) <= 1 or bad[1] == "a"
    assert time.perf_counter() - start < 5


def test_pii_method_on_planted_rows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(3, 8)))
    fill = lambda: " ".join(word() for _ in range(6))
    rows, planted, clean = [], {}, set()
    for i in range(600):
        kind, before = i % 6, fill() + " "
        if kind == 0:
            before, span, name = before + "token = \"", "".join(rng.choice("0123456789abcdef") for _ in range(40)), "secret"
        elif kind == 1:
            before, span, name = before + "mail me: ", f"{word()} (at) {word()} (dot) org", "email"
        elif kind == 2:
            before, span, name = before + "IBAN ", "GB82 WEST 1234 5698 7654 32", "account"
        elif kind == 3:  # look-alikes
            before, span, name = before + "we meet", f" at {word()}. Then", None
        elif kind == 4:
            before, span, name = before + "order ", "".join(rng.choice("123456789") for _ in range(15)) + "0", None
        else:
            before, span, name = before, "".join(rng.choice("abcdefghi") for _ in range(28)), None
        text = before + span + ("\" " if kind == 0 else " ") + fill()
        rows.append((i, text))
        if name:
            planted[i] = f"{name}:{len(before)}:{len(before) + len(span)}"
        elif not (kind == 4 and _spans(text)):
            clean.add(i)
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = [k for k, s in planted.items() if s in got[k].spans.split(",")]
    base = [k for k in planted if got[k].n_spans - got[k].n_added > 0]
    assert len(hit) > 0.95 * len(planted) and not base
    assert sum(got[k].n_spans > 0 for k in clean) <= 0.02 * len(clean)


def test_pii_reliabilities():
    """Expectation-maximisation tells a labeler that votes at random from those that are right."""
    rng, counts = random.Random(2), {}
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = lambda right: pii.FOR_IT if (rng.random() < right) == true else pii.AGAINST_IT
        v = sum(d * 3**j for j, d in enumerate((vote(0.95), vote(0.9), vote(0.5), vote(0.85))))
        counts[v] = counts.get(v, 0) + 1
    model = pii.fit([("secret", v, 8, n) for v, n in counts.items()])
    found = [model.reliability["secret", j] for j in range(4)]
    assert found[0] > 0.9 and found[1] > 0.85 and found[3] > 0.8 and 0.4 < found[2] < 0.6


def test_pii_many_spans_and_masks(spark):
    many = " ".join(f"u{i}@x.org," for i in range(3000))
    df = spark.createDataFrame([(1, many, "en", "s", 0), (2, "a@b.co +49 170 1234567 and 4111111111111111 or 1.2.3.4", "en", "s", 0), (3, "+4111 1111 1111 1111 11@x.org é", "en", "s", 0)], DOCS)
    got = {r.doc_id: r for r in pii.find_spans(df).collect()}
    assert got[1].n_email == 3000 and got[1].spans.split(",")[:3] == [f"{k}:{m.start()}:{m.end()}" for k, m in zip(["email"] * 3, re.finditer(r"u\d+@x\.org", many))]
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[1] == re.sub(r"u\d+@x\.org", "<EMAIL>", many) and masked[2] == "<EMAIL> <PHONE> and <CARD> or <IP>"
    assert masked[3].endswith("é") and "@" not in masked[3]
