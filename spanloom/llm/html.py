"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of text runs and tags. Words score positive, tags negative;
the scores are log odds of being inside the content, learned from pages that
mark it with an article element. A linear scan finds the contiguous region of
the largest sum, and its blocks are the page's text. Elements that never hold
content (scripts, menus, forms, comments, ...) end any region they would cross
or, inside one, are left out.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)\b(?:(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))(?:(?<=/>)|.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|[^<>]*>)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_WALL = frozenset("nav footer aside form menu dialog button head fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DROPPED = frozenset("noscript template svg select object".split())
_OPTIONAL = frozenset("p li dt dd td th tr tbody thead tfoot caption head body html".split())
# Fixed values, of the HTML standard: which open elements a start tag ends, and the open elements beyond which it does not look.
_TABLE = ("table", "td", "th", "caption", "template")
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", *_TABLE)), "dt": (("dt", "dd"), ("dl", *_TABLE)), "dd": (("dt", "dd"), ("dl", *_TABLE)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "caption"), ("table",)), "body": (("head",), ()),
    **{x: (("tbody", "thead", "tfoot", "caption"), ("table",)) for x in ("tbody", "thead", "tfoot")},
}
_HEAD = frozenset("html head base basefont link meta noscript template object".split())
_NAMES = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|side-?bar\w*|footer\w*|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|pop-?up|modal|comments?|commentary|disqus|repl(?:y|ies)|responses|share|sharing|social|related|recommend\w*|newsletter|subscribe|sign-?up|log-?in|search\w*|widgets?|pagination|pager|skip\w*)"
)
_NAMED = re.compile(_NAMES, re.I)
#: Ends of compound names that say nothing of what is inside, and beginnings that speak of something elsewhere.
_NEUTRAL = frozenset("area bar block box buttons col column container group holder icons inner item items left link links list lists nav outer panel posts articles stories right row section sections slot text title top bottom unit wrap wrapper zone".split())
_ELSEWHERE = frozenset("has no with without not is show hide hides non".split())
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|top-?bar|page-?top)(?:$|[\s_-])", re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())


def _named(value: str, inside: bool) -> int:
    """2 if a class or id is by itself the name of a part without content, 1 if the head of a compound is, else 0."""
    found = 0
    for token in value.split():
        if _NAMED.fullmatch(token):
            return 2
        parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", token) if p]
        while len(parts) > 1 and parts[-1].lower() in _NEUTRAL:
            parts.pop()
        if not inside and parts and parts[0].lower() not in _ELSEWHERE and _NAMED.fullmatch(parts[-1]):
            found = 1
    return found


def _walled(name: str, attrs: str, inside: bool) -> int:
    """2 for an element without content, 1 for one that is so unless an article or main element lies in it, 0 for others."""
    if name in _WALL or (name == "header" and not inside):
        return 2
    if not attrs or name in ("html", "body", "article", "main"):
        return 0
    found = 0
    for key, a, b, c in _ATTR.findall(attrs):
        value, key = a or b or c, key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return 2
        if key == "role" and value.lower() in _ROLES:
            return 2
        if key in ("class", "id"):
            if not inside and _HEADER.search(value):
                found = max(found, 1)
            found = max(found, _named(value, inside))
    return found


class _Open:
    """The open elements, and where those that ended did: (token, whether by a tag of their own)."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = []
        self.blocks: list[int] = []
        self.depths: dict[str, list[int]] = {}
        self.ends: dict[int, tuple[int, bool]] = {}

    def deepest(self, names: tuple[str, ...]) -> int:
        return max((d[-1] for x in names if (d := self.depths.get(x))), default=-1)

    def pop(self, depth: int, at: int) -> None:
        """Ends all elements from this depth on."""
        while len(self.stack) > depth:
            i, name = self.stack.pop()
            self.ends.setdefault(i, (at, False))
            for own in (self.depths[name], self.blocks):
                if own and own[-1] == len(self.stack):
                    own.pop()

    def start(self, name: str, at: int) -> None:
        head = self.deepest(("head",))
        if head >= 0 and name not in _HEAD and self.deepest(("noscript", "template", "object")) < head:
            self.pop(head, at)
        for gone, fence in ((("p",), ("button", "object", "svg", *_TABLE)) if name in _P_ENDS else ((), ()), _IMPLIED.get(name, ((), ()))):
            depth = self.deepest(gone)
            if depth > self.deepest(fence):
                self.pop(depth, at)
        if name in ("a", "button"):
            self.end(name, at, own=False)

    def push(self, name: str, at: int) -> None:
        if name in _BLOCK or name in _DROPPED:
            self.blocks.append(len(self.stack))
        self.depths.setdefault(name, []).append(len(self.stack))
        self.stack.append((at, name))

    def end(self, name: str, at: int, own: bool = True) -> None:
        depth = self.deepest((name,))
        fence = () if name in ("table", "template", "body", "html") else ("table", "template") if name in _OPTIONAL and name not in ("p", "li", "dt", "dd") else _TABLE
        if depth < 0 or depth < self.deepest(tuple(x for x in fence if x != name)):
            return
        self.ends[self.stack[depth][0]] = (at, own)
        if name in _BLOCK or name in _DROPPED or not self.blocks or self.blocks[-1] < depth:
            self.pop(depth, at)
        else:  # blocks opened inside an inline element go on after its end
            self.depths[name].pop()


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(tag name or '', text, inside marked content, inside an element without content) in page order. Marked is what lies in article elements, or, on a page without any, in main elements.

    End tags may be missing: an element ends with the element around it, and
    earlier where the HTML standard lets a start tag end it. One that should
    have had an end tag has no content beyond the next article or main element.
    An element whose compound name ends like a part without content has some only
    in the article or main elements that it holds.
    """
    found: list[tuple[str, str, str]] = []
    at, open_ = 0, _Open()
    mains: list[int] = []
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            found.append(("", page[at : m.start()], ""))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        attrs = m[4][:-1].rstrip()
        if m[2]:
            open_.end(name, len(found))
        else:
            open_.start(name, len(found))
            if name in ("article", "main"):
                mains.append(len(found))
            if name not in _VOID and not attrs.endswith("/"):
                open_.push(name, len(found))
        found.append((name, "/" if m[2] else "", attrs))
    if at < len(page):
        found.append(("", page[at:], ""))
    open_.pop(0, len(found))

    marks = "article" if any(name == "article" and not text for name, text, _ in found) else "main"
    out, articles, inside, until, dropped, main, formula = [], 0, 0, -1, False, 0, -1
    for i, (name, text, attrs) in enumerate(found):
        if name == "article" and text:
            articles = max(0, articles - 1)
        if name == marks and text:
            inside = max(0, inside - 1)
        wall = i > until and i in open_.ends and (2 if name in _DROPPED else _walled(name, attrs, articles > 0))
        held = bisect_right(mains, i)
        if wall == 2 or (wall == 1 and not (held < len(mains) and mains[held] < open_.ends[i][0])):
            end, own = open_.ends[i]
            until = end if own else end - 1
            if not own and name not in _OPTIONAL:
                while main < len(mains) and mains[main] <= i:
                    main += 1
                until = min(until, mains[main] - 1) if main < len(mains) else until
            dropped = name in _DROPPED
        if name == "math" and i in open_.ends:
            formula = max(formula, open_.ends[i][0])
        if (i > until or not dropped) and (i > formula or not name or name in _BLOCK):  # a formula is its text alone
            out.append((name, text, inside > 0, i <= until))
        if name == "article" and not text:
            articles += 1
        if name == marks and not text:
            inside += 1
    return out


class Extractor:
    """Best region of a page under given scores; of equal ones the first, and of those the shortest."""

    def __init__(self, weights: dict[str, float]):
        self.word, self.other, self.tags = weights.get("", 0.7), weights.get("?", -1.0), weights

    def text(self, page: str | None) -> str:
        """The region's blocks joined by a line feed; '' for null and for pages without words."""
        seq = tokens(page or "")
        best, run, start, span = 0.0, 0.0, 0, None
        marked = any(inside and not name and not walled for name, _, inside, walled in seq)
        for i, (name, text, inside, walled) in enumerate(seq):
            if inside and (walled or name):
                score = -1e-9  # markup inside marked content never ends it, however much there is
            elif walled:
                score = -1e-3 if run <= 0 else -0.5 * bool(name)
            elif name:
                score = self.tags.get(name, self.other)
            else:  # a page that marks its content says that other words are none
                score = self.word * len(text.split()) if inside or not marked else 0.0
            if run <= 0 < score:
                run, start = 0.0, i
            run = max(0.0, run + score)
            if run > best:
                best, span = run, (start, i)
        if span is None:
            return ""
        low, high = span
        while low > 0 and not (seq[low - 1][0] in _BLOCK or seq[low - 1][3]):
            low -= 1
        while high + 1 < len(seq) and not (seq[high + 1][0] in _BLOCK or seq[high + 1][3]):
            high += 1
        blocks: list[str] = []
        own: list[str] = []
        for name, text, _, walled in seq[low : high + 1]:
            if name in _BLOCK:
                blocks.append("".join(own))
                own = []
            elif name == "br":
                own.append(" ")
            elif not name and not walled:
                own.append(text)
        blocks.append("".join(own))
        return "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def learn_weights(pages: DataFrame, *, column: str = "html", sample: int = 20_000, names: int = 500) -> dict[str, float]:
    """Log odds of words ('') and tags from pages that have an article element.

    About ``sample`` labelled pages, chosen by the hash of their text, are read
    (all if there are fewer), without the elements that are left out; the most
    frequent ``names`` tags get a score of their own, the others ('?') that of all
    tags together. Words are kept above 0.2 and tags below -0.05, so that words
    stay positive and tags negative. Without labelled pages the result is empty
    and fixed scores hold.
    """
    marked = pages.where(F.col(column).contains("<article")).select(F.col(column).alias("h"))
    total = marked.count()
    share = F.xxhash64("h").bitwiseAND(F.lit((1 << 20) - 1)) / F.lit(float(1 << 20))
    chosen = marked.where(share < sample / max(total, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for page in batch.column(0).to_pylist():
                for name, text, inside, walled in tokens(page):
                    if walled:  # what is left out anyway tells nothing of where the rest ends
                        continue
                    n = 1 if name else len(text.split())
                    c = found.setdefault(name, [0, 0])
                    c[inside and not (name == "article")] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([c[1] for c in found.values()], pa.int64()), pa.array([c[0] for c in found.values()], pa.int64())], ["tag", "inside", "outside"])

    rows = chosen.mapInArrow(count, "tag string, inside long, outside long").groupBy("tag").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    out = {}
    every = rows.where("tag <> ''").agg(F.sum("inside"), F.sum("outside")).first()
    if every[0] is not None:
        out["?"] = min(-0.05, max(-6.0, math.log((every[0] + 1) / (every[1] + 1))))
    for name, inside, outside in rows.orderBy(F.desc(F.col("inside") + F.col("outside")), "tag").limit(names).collect():
        odds = math.log((inside + 1) / (outside + 1))
        out[name] = min(1.0, max(0.2, odds)) if not name else min(-0.05, max(-6.0, odds))
    return out


def extract(pages: DataFrame, weights: dict[str, float], *, column: str = "html") -> DataFrame:
    """pages without its html, with text and n_chars.

    Null and empty pages give '' and 0; repeated rows are each extracted; an
    empty table gives an empty result. Columns named like a result are replaced.
    """
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(weights)
        for batch in batches:
            found = [extractor.text(p) for p in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*kept, "text", "n_chars"])

    return pages.select(*kept, column).mapInArrow(run, schema)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn_weights(pages))
