"""Personal data by weakly supervised span classification, in DataFrame functions alone.

Base spans come from strict patterns. Looser patterns give further candidates,
of the base kinds and of three more (secrets, account numbers, identity
numbers); they take in look-alikes on purpose. Four labelers vote for or against
every candidate or abstain: its form (checks of digits, known prefixes), a
gazetteer (top-level domains, card issuers, number plans, countries), the words
before it, and the characters around it. Expectation-maximisation over the counts
of vote patterns estimates each labeler's reliability and each pattern's
probability of being personal data; these probabilities, as soft labels, train
the final classifier, a naive Bayes model over the votes and the span's shape.
Candidates it accepts are added to the base spans, which always stay.

Patterns have no repeated group that can back up, so that matching is linear and
needs no deep stack on long runs of digits or letters.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import let, stored, table

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("secret", "account", "id")
ALL = KINDS + EXTRA

# Base patterns of each kind, in forms that match the same spans without backing up.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9](?:[ -]?[0-9]){15})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9.])[0-9]{1,6}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,6}){3}(?![0-9.])",
    "card": r"(?<![0-9.-])(?:[0-9]{4}[ ./-]?[0-9]{4}[ ./-]?[0-9]{4}[ ./-]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9.-])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:00[1-9][0-9]{0,2}[ .-])?\(?[0-9]{3,5}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,200}+(?![A-Za-z0-9_+/=-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])",
}
#: Texts a base match needs, and a pattern a candidate's text needs, to be searched at all.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
NEED = {"email": r"[({\[ ]at[)}\] ]", "ip": r"[0-9] ?[.\[(]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{4}", "phone": "[0-9]{3}", "secret": None, "account": "[A-Z]{2}[0-9]{2}", "id": "[0-9]{3}[ -][0-9]{2}[ -]"}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]} ]) ?(?:com|org|net|edu|gov|int|mil|info|biz|io|ai|app|dev|co|eu|us|uk|ca|au|de|at|ch|fr|be|es|mx|ar|it|pt|br|nl|se|no|dk|fi|pl|cz|ru|jp|cn|kr|in|example|test)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[ .\[(]|^[23][0-9A-Fa-f]{3}:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+|00)[1-9]|^\(?0?[2-9][0-9]{2,3}\)?[ ./-][2-9][0-9]{2}",
    "secret": r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])(?:[^0-9]*+[0-9]){3}",
    "account": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR)",
    "id": r"^(?!000|666|9)[0-9]{3}[ -](?!00)[0-9]{2}[ -](?!0000)[0-9]{4}$",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|courriel|schreib)[^.]{0,20}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|from|client)[^.]{0,20}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|carte|karte|tarjeta)[^.]{0,20}$",
    "phone": r"(?i)(?:call|tel|phone|mobile|cell|fax|whatsapp|ruf|appel|llam)[^.]{0,20}$",
    "secret": r"(?i)(?:token|key|secret|passw|pwd|bearer|auth|credential|clave|schlüssel|clé)[^.]{0,12}$",
    "account": r"(?i)(?:iban|account|bank|konto|compte|cuenta)[^.]{0,20}$",
    "id": r"(?i)(?:ssn|social security|passport|\bid\b|tax|ausweis|identi)[^.]{0,20}$",
}
#: Words before look-alikes: what follows is no personal data.
AGAINST = {k: r"(?i)(?:version|release|build|order|invoice|ticket|isbn|part|item|serial|model|price|section|page|chapter|figure|table)[^.]{0,12}$" for k in ALL}
AGAINST["email"] = r"(?i)(?:look|arriv|meet|stay|stop|laugh|aim|was|is|are|were)[^.]{0,4}$"
AGAINST["secret"] = r"(?i)(?:https?:|www\.|file|path|commit|sha[0-9]*|md5|checksum|hash)[^ ]{0,12} ?$"
VOTES, ABSTAIN, AGAINST_IT, FOR_IT = 4, 0, 1, 2
LABELERS = ("form", "gazetteer", "context", "border")
_BLOCK = 256
_SPAN = "array<struct<s:int,e:int,m:string,b:string,a:string>>"


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of the numbers, what merge (a sum or a maximum) makes of 0 and those before it. Blocks keep it near linear."""
    blocks = F.sequence(F.lit(0), F.size(values) - 1, F.lit(_BLOCK))
    none = F.array().cast("array<int>")

    def grow(start: Column, part: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), none.alias("out"))
        step = lambda acc, v: F.struct(merge(acc["at"], v).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, first, step, lambda acc: acc["out"])

    def whole(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, v: merge(acc, v).cast("int"))

    def inside(starts: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, j: grow(F.get(starts, j), F.slice(values, b + 1, _BLOCK))))

    sums = F.transform(blocks, lambda b: whole(F.slice(values, b + 1, _BLOCK)))
    return F.when(F.size(values) == 0, none).otherwise(let(grow(F.lit(0), sums), inside))


def matches(text: Column, pattern: str) -> Column:
    """All matches of pattern as an array of (s, e, m, b, a): code points, end exclusive, the matched text, and up to 32 and 1 characters around it since the match before and up to the next."""

    def placed(found: Column) -> Column:
        def walk(gaps: Column) -> Column:
            sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

            def spans(at: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    s = F.get(at, i) + F.length(F.get(gaps, i))
                    return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), F.right(F.get(gaps, i), F.lit(32)).alias("b"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("a"))

                return F.transform(found, one)

            return let(let(sizes, lambda n: running(n, lambda x, y: x + y)), spans)

        return let(F.split(text, pattern, -1), walk)

    none = F.array().cast(_SPAN)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":
        part = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Base spans of one kind: array of (s, e, m, b, a)."""
    hint, none = HINT[kind], F.array().cast(_SPAN)
    found = F.filter(matches(text, BASE[kind]), lambda x: passes(kind, x["m"]))
    can = text.rlike("[0-9]") if hint is None else text.contains(hint)
    return F.when(can, found).otherwise(none)


def _remainder(m: Column) -> Column:
    """An account number modulo 97, its first four characters moved to the end and letters counted from 10."""
    plain = F.upper(F.regexp_replace(m, " ", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _form(kind: str, m: Column) -> tuple[Column, Column]:
    """Whether a candidate's form speaks for it, and against it."""
    if kind == "card":
        return luhn(_digits(m)), ~luhn(_digits(m))
    if kind == "account":
        return _remainder(m) == 1, _remainder(m) != 1
    if kind == "ip":
        low = F.forall(F.split(F.regexp_replace(m, r"[\[\]() ]", ""), r"[.]"), lambda x: F.length(F.ltrim(F.lit("0"), x)).between(0, 3) & (F.coalesce(F.substring(x, -4, 4).try_cast("int"), F.lit(0)) <= 255))
        return m.contains(":") | low, ~low & ~m.contains(":")
    if kind == "phone":
        size = F.length(_digits(m))
        return m.rlike(r"^(?:\+|00|\()"), ~size.between(8, 15)
    if kind == "secret":
        return m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ghp_|gho_|sk-|sk_|pk_|xox[abp]-|eyJ|glpat-)[A-Za-z0-9_+/=-]+)$"), m.rlike(r"^[A-Za-z]+[=-]*$|^[0-9]+$|^[_+/=-]+$|/.*/")
    if kind == "email":
        return m.contains("@") | m.rlike(r"(?i)[(\[{](?:at|dot)[)\]}]"), m.rlike(r"\. [A-Z]")
    return F.lit(False), F.lit(False)


def _candidates(text: Column, base: Column | None, kind: str) -> Column:
    """Base spans and loose matches clear of them, with votes and shape: array of (s, e, base, v, f)."""
    none = F.array().cast(_SPAN)
    loose = matches(text, LOOSE[kind])
    if NEED[kind] is not None:
        loose = F.when(text.rlike(NEED[kind]), loose).otherwise(none)

    def described(x: Column, strict: bool) -> Column:
        good, bad = (F.lit(True), F.lit(False)) if strict else _form(kind, x["m"])
        glued = x["b"].rlike(r"[\w@:/-]$") | x["a"].rlike(r"^[\w@:/]")
        votes = [
            F.when(good, FOR_IT).when(bad, AGAINST_IT).otherwise(ABSTAIN),
            F.when(x["m"].rlike(GAZETTEER[kind]), FOR_IT).otherwise(AGAINST_IT),
            F.when(x["b"].rlike(CONTEXT[kind]), FOR_IT).when(x["b"].rlike(AGAINST[kind]), AGAINST_IT).otherwise(ABSTAIN),
            F.when(glued, AGAINST_IT).otherwise(FOR_IT),
        ]
        v = sum((c * 3**k for k, c in enumerate(votes)), F.lit(0))
        size, digits = F.least(F.floor(F.length(x["m"]) / 6), F.lit(7)), F.least(F.floor(F.length(_digits(x["m"])) / 3), F.lit(7))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(strict).alias("base"), v.cast("int").alias("v"), (size * 8 + digits).cast("int").alias("f"))

    if base is None:
        return F.transform(loose, lambda x: described(x, False))

    def both(b: Column) -> Column:
        clear = F.filter(loose, lambda x: ~F.exists(b, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
        return F.concat(F.transform(b, lambda x: described(x, True)), F.transform(clear, lambda x: described(x, False)))

    return let(base, both)


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with an array of candidates for each kind, named __<kind>; a null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_base = docs.select("*", *(base_spans(t, k).alias(f"__b_{k}") for k in KINDS))
    return with_base.select(*docs.columns, *(_candidates(t, F.col(f"__b_{k}") if k in KINDS else None, k).alias(f"__{k}") for k in ALL))


@dataclass(frozen=True)
class SpanModel:
    """log odds of a span: prior by kind, and weights by kind, labeler and vote, and by kind and shape; reliability by kind and labeler."""

    prior: dict[str, float]
    votes: dict[tuple[str, int], tuple[float, float, float]]
    shape: dict[tuple[str, int], float]
    reliability: dict[tuple[str, int], float]


def train(found: DataFrame) -> SpanModel:
    """Fits the model to the candidates of all documents.

    The executors count candidates by kind, votes and shape: at most 7 * 81 * 64
    rows, whatever the input, which the driver then fits.
    """
    def of(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda x: F.struct(F.lit(kind).alias("k"), x["v"].alias("v"), x["f"].alias("f")))

    each = F.explode(F.flatten(F.array(*map(of, ALL)))).alias("x")
    return fit([(r[0], r[1], r[2], r[3]) for r in found.select(each).groupBy("x.k", "x.v", "x.f").count().collect()])


def fit(counts: list[tuple[str, int, int, int]], rounds: int = 60, weight: float = 8.0) -> SpanModel:
    """The model of counts (kind, votes, shape, number of candidates).

    Each labeler starts as one that is mostly right; that opinion weighs as much
    as ``weight`` candidates, so a kind with few candidates stays near it.
    """
    start = {1: ((0.1, 0.1, 0.8), (0.2, 0.6, 0.2)), 2: ((0.34, 0.06, 0.6), (0.5, 0.4, 0.1))}
    begin = [start[1], start[1], start[2], start[1]]
    prior, votes, shape, reliability = {}, {}, {}, {}
    for kind in ALL:
        own = [(v, f, n) for k, v, f, n in counts if k == kind]
        by_votes: dict[int, float] = {}
        for v, _, n in own:
            by_votes[v] = by_votes.get(v, 0) + n
        share, hit, miss = 0.5, [list(b[0]) for b in begin], [list(b[1]) for b in begin]
        soft: dict[int, float] = {}
        for _ in range(rounds if own else 0):
            for v in by_votes:
                odds = math.log(share / (1 - share)) + sum(math.log(hit[j][d] / miss[j][d]) for j in range(VOTES) for d in [v // 3**j % 3])
                soft[v] = 1 / (1 + math.exp(min(700.0, max(-700.0, -odds))))
            pos = sum(n * soft[v] for v, n in by_votes.items())
            neg = sum(n * (1 - soft[v]) for v, n in by_votes.items())
            share = min(0.99, max(0.01, (pos + weight / 2) / (pos + neg + weight)))
            for j in range(VOTES):
                for d in range(3):
                    voted = [(v, n) for v, n in by_votes.items() if v // 3**j % 3 == d]
                    hit[j][d] = (sum(n * soft[v] for v, n in voted) + weight * begin[j][0][d]) / (pos + weight)
                    miss[j][d] = (sum(n * (1 - soft[v]) for v, n in voted) + weight * begin[j][1][d]) / (neg + weight)
        pos = sum(n * soft[v] for v, _, n in own)
        neg = sum(n * (1 - soft[v]) for v, _, n in own)
        prior[kind] = math.log(share / (1 - share))
        for j in range(VOTES):
            votes[kind, j] = tuple(math.log(h / m) for h, m in zip(hit[j], miss[j]))
            right = share * hit[j][FOR_IT] + (1 - share) * miss[j][AGAINST_IT]
            wrong = share * hit[j][AGAINST_IT] + (1 - share) * miss[j][FOR_IT]
            reliability[kind, j] = right / (right + wrong)
        for f in {f for _, f, _ in own}:
            a = sum(n * soft[v] for v, g, n in own if g == f)
            b = sum(n * (1 - soft[v]) for v, g, n in own if g == f)
            shape[kind, f] = math.log((a + 1) / (pos + 64)) - math.log((b + 1) / (neg + 64))
    return SpanModel(prior, votes, shape, reliability)


def _accepted(x: Column, kind: str, model: SpanModel, least: float) -> Column:
    odds = F.lit(model.prior[kind])
    for j in range(VOTES):
        by_vote = F.array(*map(F.lit, model.votes[kind, j]))
        odds = odds + F.get(by_vote, F.floor(x["v"] / 3**j).cast("int") % 3)
    shapes = [p for (k, f), w in sorted(model.shape.items()) if k == kind for p in (F.lit(f), F.lit(w))]
    if shapes:
        odds = odds + F.coalesce(F.element_at(F.create_map(*shapes), x["f"]), F.lit(0.0))
    return odds >= math.log(least / (1 - least))


def classified(found: DataFrame, model: SpanModel, least: float) -> DataFrame:
    """The base spans and accepted candidates of each kind, by start."""

    def keep(kind: str) -> Column:
        good = F.filter(f"__{kind}", lambda x: x["base"] | _accepted(x, kind, model, least))
        return F.sort_array(F.transform(good, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))))

    return found.select(*(c for c in found.columns if c not in [f"__{k}" for k in ALL]), *(keep(k).alias(f"__{k}") for k in ALL))


def _joined(kinds: tuple[str, ...], base_only: bool) -> Column:
    def part(kind: str) -> Column:
        spans = F.filter(f"__{kind}", lambda x: x["base"]) if base_only else F.col(f"__{kind}")
        return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))

    return F.array_join(F.concat(*map(part, kinds)), ",")


def find_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """Rows (key, n_<kind> of base spans, base_sha256, spans, n_spans, n_added) for every row of docs.

    Null and empty texts have no spans; repeated rows are each searched; an
    empty table gives an empty result; other columns are not read. Spans of one
    kind never overlap a base span of it; spans of different kinds may overlap,
    and each is given. Candidates are found once and kept in the shared folder.
    """
    found = stored(candidates(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__text").drop("__text"), "candidates")
    done = classified(found, train(found), least)
    count = lambda k, base: F.size(F.filter(f"__{k}", lambda x: x["base"] == base)).cast("long")
    every = sum((F.size(f"__{k}").cast("long") for k in ALL), F.lit(0).cast("long"))
    return done.select(
        F.col("__key").alias(key), *(count(k, True).alias(f"n_{k}") for k in KINDS), F.sha2(_joined(KINDS, True), 256).alias("base_sha256"), _joined(ALL, False).alias("spans"),
        every.alias("n_spans"), sum((count(k, False) for k in ALL), F.lit(0).cast("long")).alias("n_added"),
    )


def mask(docs: DataFrame, *, text: str = "text", length: str = "n_chars", least: float = 0.9) -> DataFrame:
    """docs with every span replaced by the name of its kind in angle brackets, and length set anew.

    Overlapping spans become one mask, named after the first, of equal starts
    the shorter. Null texts stay null; repeated rows are each masked; an empty
    table gives an empty result. All columns come back, in order; names that
    begin with two underscores and a kind are taken.
    """
    found = stored(candidates(docs, text), "candidates")
    done = classified(found, train(found), least)

    def named(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind.upper()}>").alias("name")))

    def masked(spans: Column) -> Column:
        def put_together(before: Column) -> Column:
            def block(b: Column) -> Column:
                low = F.get(before, b)
                part = F.slice(spans, b + 1, _BLOCK)
                high = F.greatest(low, F.array_max(F.transform(part, lambda x: x["s"])))

                def pieces(own: Column) -> Column:
                    def piece(x: Column, i: Column) -> Column:
                        at = F.get(before, b + i)
                        return F.when(x["s"] >= at, F.concat(F.substring(own, at - low + 1, x["s"] - at), x["name"])).otherwise("")

                    return F.array_join(F.transform(part, piece), "")

                return let(F.substring(F.col(text), low + 1, high - low), pieces)

            end = F.array_max(F.transform(spans, lambda x: x["e"]))
            blocks = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(_BLOCK)), block)
            return F.concat(F.array_join(blocks, ""), F.substring(F.col(text), end + 1, F.length(text)))

        return let(running(F.transform(spans, lambda x: x["e"]), F.greatest), put_together)

    spans = F.sort_array(F.concat(*map(named, ALL)))
    out = done.withColumn("__spans", spans).withColumn("__masked", F.when(F.size("__spans") == 0, F.col(text)).otherwise(let(F.col("__spans"), masked)))
    changed = {text: F.col("__masked"), length: F.length("__masked")}
    types = dict(docs.dtypes)
    return out.select(*(changed[c].cast(types[c]).alias(c) if c in changed else F.col(c) for c in docs.columns))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
