"""Token counts by prefix dynamic programming.

The tokens of a piece (a word or a run of marks) follow from those of its
prefixes: the last token of a prefix is the one ending there that stays apart
from the last token of what is before it, so one more than the count before it
is the count of the prefix. A word-end mark belongs to the last symbol, so every
prefix has an open form (more symbols follow) and a closed one (it is the whole
piece); closed forms are built on open ones. The count of every prefix of a text,
by code points, is kept as the differences of neighbouring prefixes, and answers
what a text costs, what any prefix of it costs, and how much of it fits into a
limit, without encoding anything again.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType
from tokenizers import Tokenizer

from spanloom.llm.shared import Memory, sliced, table

LIMIT = 2048
#: Pieces that the split pattern takes as a whole though their prefixes fall into two.
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
SHIFT = 20  # bits of a token's number
SHARED = 24  # symbols up to which the states of prefixes are remembered for other pieces
#: Characters that normalisation may do more to than give them one small letter each.
OTHER = regex.compile(r"[^\x00-\u012f\u0131-\u02ff]")
#: The split pattern among the others.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0d\x20\x85\xa0\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others in order for the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


BYTE = _byte_letters()


class Merges:
    """The merges of a vocabulary, its tokens as numbers, an automaton of their symbols, and whether two tokens stay apart."""

    def __init__(self, merges: list, suffix: str, most: int = 400_000):
        self.most = most
        number: dict[str, int] = {}
        token = lambda t: number.setdefault(t, len(number))
        for b in BYTE:
            token(b), token(b + suffix)
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for i, pair in enumerate(merges):
            a, b = map(token, pair if not isinstance(pair, str) else pair.split(" "))
            whole = token((pair[0] + pair[1]) if not isinstance(pair, str) else pair.replace(" ", ""))
            self.rank[a << SHIFT | b] = i
            self.made.setdefault(whole, (i, a, b))
        by_symbols: dict[str, list[int]] = {}
        for t, n in number.items():
            ends = bool(suffix) and t.endswith(suffix)
            for closes in (True, False) if not suffix else (ends,):
                by_symbols.setdefault(t.removesuffix(suffix), [-1, -1])[closes] = n
        self.longest = max(map(len, by_symbols))
        self.automaton = ahocorasick.Automaton()
        for t, (opens, closes) in by_symbols.items():
            self.automaton.add_word(t, (len(t), opens, closes))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        self.states: dict[str, tuple[int, int, int]] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b both come out when their symbols are merged side by side.

        Their merges are undone from the latest on; a merge over the border comes
        first if it is earlier than the one that takes its left side away, and no
        later than the one that takes its right side away.
        """
        x, y, left, right, found = a, b, len(self.rank), len(self.rank), True
        while True:
            over = self.rank.get(x << SHIFT | y)
            if over is not None and over < left and over <= right:
                found = False
                break
            of_x, of_y = self.made.get(x), self.made.get(y)
            if of_x is not None and (of_y is None or of_x[0] > of_y[0]):
                left, x = of_x[0], of_x[2]
            elif of_y is not None:
                right, y = of_y[0], of_y[1]
            else:
                break
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[a << SHIFT | b] = found
        return found


class Piece:
    """The last token (-1 before the first) and the number of tokens of every open prefix of a piece's symbols, and closed[i], the tokens of the first i symbols as a piece of their own."""

    def __init__(self, merges: Merges, symbols: str = "", begun: tuple[str, list[int], list[int]] | None = None):
        self.merges = merges
        self.text, self.last, self.count = begun or ("", [-1], [0])
        at, self.text = len(self.text), self.text + symbols
        last, count, known, apart = self.last, self.count, merges.known.get, merges.apart
        self.closed = closed = [0] * len(last)
        text, states, shared = self.text, merges.states, begun is None
        if shared:  # what pieces with the same beginning have found
            for end in range(1, min(len(text), SHARED) + 1):
                state = states.get(text[:end])
                if state is None:
                    break
                last.append(state[0])
                count.append(state[1])
                closed.append(state[2])
            at = len(last) - 1
            if at == len(text):
                return
        more = [0] * (len(text) - at)
        last += more
        count += more
        closed += more
        # all tokens that end at a place come before those that end behind it
        for end, (size, opens, closes) in merges.automaton.iter(text, max(0, at + 1 - merges.longest)):
            end += 1
            if end <= at:
                continue
            before = last[end - size]
            if before < 0:
                if opens >= 0:
                    last[end], count[end] = opens, 1
                if closes >= 0:
                    closed[end] = 1
                continue
            if opens >= 0 and not count[end]:
                ok = known(before << SHIFT | opens)
                if apart(before, opens) if ok is None else ok:
                    last[end], count[end] = opens, count[end - size] + 1
            if closes >= 0 and not closed[end]:
                ok = known(before << SHIFT | closes)
                if apart(before, closes) if ok is None else ok:
                    closed[end] = count[end - size] + 1
        if shared:
            if len(states) >= merges.most:
                states.clear()
            for end in range(at + 1, min(len(text), SHARED) + 1):
                states[text[:end]] = last[end], count[end], closed[end]

    def going_on(self, end: int, symbols: str) -> int:
        """Tokens of the first ``end`` symbols and these as one piece; only the states that a token can reach back to are read."""
        low = max(0, end - self.merges.longest)
        if not symbols:
            return self.closed[end]
        return Piece(self.merges, symbols, (self.text[low:end], self.last[low : end + 1], self.count[low : end + 1])).closed[-1]


@lru_cache(1)
def _seconds() -> frozenset[str]:
    """Characters that composition may join to the one before them."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def _joins_back(c: str) -> bool:
    """Whether normalisation may change c together with what is before it."""
    if c < "\x80":
        return False
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) != 0 or first in _seconds()


class PrefixCounter:
    """Counts of all prefixes of texts, as the tokenizers library counts each prefix encoded without added tokens."""

    def __init__(self, path: str, most: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level merges are counted")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only added tokens that stand in the text as they are")
        self.special = [t["content"] for t in added]
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(model["merges"], model.get("end_of_word_suffix") or "")
        self.memory = Memory(self._narrow, most)
        self.of_piece = Memory(self._piece, most)
        self.of_char = Memory(self.normal, most)

    def deltas(self, text: str) -> bytes:
        """How the count changes with each code point: a byte for the width, then signed little-endian numbers of one byte, or of four where one is too small."""
        try:
            found = b"\x01" + b"\0".join(b"\0".join([self.memory[s] for s in line.split(" ")]) for line in text.split("\n"))
        except OverflowError:
            counts = [0]
            for line in text.split("\n"):
                for s in line.split(" "):
                    base = counts[-1]
                    counts.extend(base + n for n in self.counts(s))
                    counts.append(counts[-1])
            found = b"\x04" + np.diff(np.array(counts[:-1], "<i4")).astype("<i4").tobytes()
        self.memory.turn()
        self.of_piece.turn()
        self.of_char.turn()
        return found

    def _narrow(self, stretch: str) -> bytes:
        if OTHER.search(stretch) or "<" in stretch and any(s in stretch for s in self.special):
            return _differences(self.counts(stretch))
        text = stretch.lower()
        if text.isalpha():
            return self.of_piece[text]
        out, at = [], 0
        for m in PIECE.finditer(text):
            start, end = m.span()
            if start > at:
                out.append(bytes(start - at))
            out.append(self.of_piece[text[start:end]])
            at = end
        return b"".join(out) + bytes(len(text) - at)

    def _piece(self, piece: str) -> bytes:
        """Of a whole piece of the simple letters, normalised as it is."""
        if piece in CONTRACTIONS:
            return _differences(self.counts(piece))
        if piece.isascii() and piece.isprintable():
            return _differences(Piece(self.merges, piece).closed[1:])
        closed = Piece(self.merges, "".join([BYTE[b] for b in piece.encode()])).closed
        at, ends = 0, []
        for c in piece:
            at += 1 if c < "\x80" else 2
            ends.append(closed[at])
        return _differences(ends)

    def counts(self, stretch: str) -> list[int]:
        """Tokens of each non-empty prefix of a stretch that white space, or the text's ends, set apart."""
        out: list[int] = []
        rest, base = stretch, 0
        while True:
            found = min(((at, s) for s in self.special if (at := rest.find(s)) >= 0), default=None)
            if found is None:
                out.extend(base + n for n in self._plain(rest))
                return out
            at, s = found
            # short of its last character an added token is ordinary text
            out.extend(base + n for n in self._plain(rest[: at + len(s) - 1]))
            base = (out[-len(s)] if at else base) + 1
            out.append(base)
            rest = rest[at + len(s) :]

    def _plain(self, s: str) -> list[int]:
        """Tokens of each prefix of s, which holds no whole added token.

        Normalisation works on groups of characters: one that starts anew, and
        those that it may join. Prefixes that end inside a group are normalised
        for themselves; a cut inside a piece changes that piece alone.
        """
        if not s:
            return []
        starts = list(range(len(s))) if s.isascii() else [i for i, c in enumerate(s) if i == 0 or not _joins_back(c)]
        ends = [*starts[1:], len(s)]
        groups = [self.of_char[s[a:b]] if b - a == 1 else self.normal(s[a:b]) for a, b in zip(starts, ends)]
        norm, at = "".join(groups), [0, *accumulate(map(len, groups))]
        spans, pieces, before = [], [], [0]  # where pieces lie, their states, tokens of those before
        for symbols, span in self.split(norm):
            spans.append(span)
            pieces.append(Piece(self.merges, symbols))
            before.append(before[-1] + pieces[-1].closed[-1])
        out: list[int] = []
        k = 0  # the first piece that does not end before the group
        for g, (first, end) in enumerate(zip(starts, ends)):
            while k < len(spans) and spans[k][1] < at[g]:
                k += 1
            for stop in range(first + 1, end):
                near = k if k < len(spans) and spans[k][0] < at[g] else None
                out.append(before[k] + self._after(norm, spans, pieces, near, at[g], self.normal(s[first:stop])))
            i, to = k, at[g + 1]
            while i < len(spans) and spans[i][1] < to:
                i += 1
            if i == len(spans) or spans[i][0] >= to:
                out.append(before[i])
            elif norm[spans[i][0] : spans[i][1]] in CONTRACTIONS and to < spans[i][1]:
                out.append(before[i] + self._whole(norm[spans[i][0] : to]))
            else:
                out.append(before[i] + pieces[i].closed[len(norm[spans[i][0] : to].encode())])
        return out

    def _after(self, norm: str, spans: list, pieces: list[Piece], k: int | None, at: int, tail: str) -> int:
        """Tokens of norm[:at] and ``tail`` from piece k on, which reaches ``at``; of the tail alone without one."""
        if k is None:
            return self._whole(tail)
        own = norm[spans[k][0] : at]
        if len(own) <= 3:
            return self._whole(own + tail)
        parts = self.split(own[-3:] + tail)
        more = parts[0][0][len(own[-3:].encode()) :]
        return pieces[k].going_on(len(own.encode()), more) + sum(Piece(self.merges, x).closed[-1] for x, _ in parts[1:])

    def _whole(self, text: str) -> int:
        return sum(Piece(self.merges, x).closed[-1] for x, _ in self.split(text))


def _differences(counts: list[int]) -> bytes:
    return array("b", map(sub, counts, [0, *counts])).tobytes()


def changes(stored: bytes) -> np.ndarray:
    """Differences of the counts of neighbouring prefixes, from what deltas() gives."""
    return np.frombuffer(stored, f"<i{stored[0]}", offset=1)


def prefix_tokens(stored: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points (of all, where there are fewer)."""
    return int(changes(stored)[: max(0, chars)].sum(dtype="i8"))


def fitting_chars(stored: bytes, limit: int) -> int:
    """Code points of the longest prefix with at most ``limit`` tokens; 0 where none has."""
    fits = np.flatnonzero(changes(stored).cumsum(dtype="i8") <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(2)
def _counter(path: str, most: int) -> PrefixCounter:
    return PrefixCounter(path, most)


def with_prefix_counts(docs: DataFrame, path: str, *, text: str = "text", name: str = "prefix_counts", most: int = 200_000) -> DataFrame:
    """docs and a binary column of the counts of all prefixes of their texts (of the empty text where it is null).

    All rows stay, repeated ones each; a table that has a column of that name
    already is refused. most bounds the stretches a worker remembers.
    """
    if name in docs.columns:
        raise ValueError(f"the table has a column {name} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, most)
        for batch in batches:
            for part in sliced([batch], 256):
                found = [counter.deltas(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def with_answers(counted: DataFrame, limit: int, *, name: str = "prefix_counts") -> DataFrame:
    """Counts replaced by what they answer: n_tokens, over_limit (n_tokens > limit) and fit_chars, the code points of the longest prefix within the limit."""
    more = [StructField("n_tokens", LongType()), StructField("over_limit", BooleanType()), StructField("fit_chars", LongType())]
    if taken := {f.name for f in more} & set(counted.columns):
        raise ValueError(f"the table has columns {sorted(taken)} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            stored = batch.column(name).to_pylist()
            n = [prefix_tokens(s, len(s)) for s in stored]
            fit = [len(changes(s)) if k <= limit else fitting_chars(s, limit) for s, k in zip(stored, n)]
            rest = batch.drop_columns([name])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array(fit, pa.int64())], [*rest.schema.names, *(f.name for f in more)])

    kept = [f for f in counted.schema.fields if f.name != name]
    return counted.mapInArrow(run, StructType([*kept, *more]))


def truncated(docs: DataFrame, path: str, limit: int, *, text: str = "text") -> DataFrame:
    """docs with each text cut to its longest prefix within the limit; nulls stay null, all other columns as they are."""
    counted = with_answers(with_prefix_counts(docs.select(*docs.columns), path, text=text, name="__counts"), limit, name="__counts")
    cut = F.when(F.col("over_limit"), F.expr(f"substring(`{text}`, 1, cast(fit_chars as int))")).otherwise(F.col(text))
    return counted.select(*(cut.alias(c) if c == text else F.col(c) for c in docs.columns), "n_tokens")


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    counted = with_prefix_counts(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")
    return with_answers(counted, LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")
