"""Byte-level BPE as a lazily determinised finite-state transducer.

A text of bytes has one encoding in which every pair of neighbouring tokens is
stable, that is, in which merging the joined bytes of the pair gives the pair
again; and the encoding of a prefix is found by extending those of shorter
prefixes. So after any prefix it is enough to know, for every position from
which an unfinished token may run, the token that ends there and the place in
the vocabulary's trie. The set of those pairs is a state of a deterministic
transducer. States and transitions are made when a text first needs them and
kept. Tokens go out once every open alternative agrees on them, at most a few
token lengths after their last byte.

Decoding joins the tokens' bytes chunk by chunk and feeds an incremental UTF-8
state machine, so characters split over tokens or chunks come out whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from spanloom.llm.pretokens import splitter
from spanloom.llm.shared import Memory, sliced, table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


_BITS = 24
_LOW = (1 << _BITS) - 1


class Transducer:
    """Encodes single pieces of bytes by merge ranks.

    A state is the list of its open alternatives, each a number made of the
    token before it (0 for none) and a node of the vocabulary's trie.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.next: dict[int, int] = {}
        self.token, self.depth = [-1], [0]
        for t, i in ranks.items():
            self.bytes[i] = t
            node = 0
            for b in t:
                child = self.next.get(node << 8 | b)
                if child is None:
                    child = self.next[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = child
            self.token[node] = i
        self.size = [len(t) for t in self.bytes]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.stable: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.names: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.moves: dict[int, int] = {}  # state and byte to the next state and the token that ends there
        self.start = self._name((0,))

    def _name(self, state: tuple[int, ...]) -> int:
        n = self.names.get(state)
        if n is None:
            n = self.names[state] = len(self.states)
            self.states.append(state)
        return n

    def _half(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token t; None for single bytes."""
        if t not in self.halves:
            parts = [self.bytes[t][i : i + 1] for i in range(self.size[t])]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    raise ValueError(f"token {t} is not made by merges")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[t]

    def _pair(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves a and b: no merge across the border comes before those that use up its sides."""
        ok = self.stable.get(a << 32 | b)
        if ok is None:
            if len(self.stable) >= self.max_states:
                self.stable.clear()
            ok = self.stable[a << 32 | b] = self._undone(a, b)
        return ok

    def _undone(self, a: int, b: int) -> bool:
        """The merges are undone, latest first; the tokens beside the border at any
        time are ends of a and beginnings of b. Of equal merges the leftmost is first.
        """
        left_until = right_until = 1 << 60
        while True:
            rank = self.ranks.get(self.bytes[a] + self.bytes[b], 1 << 60)
            if rank < left_until and rank <= right_until and rank < 1 << 60:
                return False
            left, right = self._half(a), self._half(b)
            if left is not None and (right is None or a > b):
                left_until, a = a, left[1]
            elif right is not None:
                right_until, b = b, right[0]
            else:
                return True

    def _move(self, state: int, byte: int) -> int:
        """The state after one more byte, and the token that ends the encoding up to there, as one number."""
        after, ended, trie = [], -1, self.next
        for alternative in self.states[state]:
            child = trie.get((alternative & _LOW) << 8 | byte)
            if child is not None:
                before = alternative >> _BITS
                after.append(before << _BITS | child)
                if ended < 0:
                    t = self.token[child]
                    if t >= 0 and (not before or self._pair(before - 1, t)):
                        ended = t
        if ended < 0:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        after.append((ended + 1) << _BITS)
        move = self.moves[state << 8 | byte] = self._name(tuple(after)) << _BITS | ended
        return move

    def stream(self, piece: bytes, every: int = 4096) -> Iterator[list[int]]:
        """Token lists of one piece, in order; all open alternatives agree on what has gone out."""
        if len(self.states) > self.max_states:
            self.forget()
        state, ends, base, moves = self.start, [], 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move >> _BITS
            ends.append(move & _LOW)
            if len(ends) - base >= every:
                at = {len(ends) - self.depth[x & _LOW] for x in self.states[state]}
                while len(at) > 1:  # step the latest alternative back until one position is left
                    late = max(at)
                    at.remove(late)
                    at.add(late - self.size[ends[late - 1]])
                agreed = at.pop()
                if agreed > base:
                    yield self._back(ends, base, agreed)
                    base = agreed
                if len(self.states) > self.max_states:
                    kept = self.states[state]
                    self.forget()
                    state, moves = self._name(kept), self.moves
        if len(ends) > base:
            yield self._back(ends, base, len(ends))

    def _back(self, ends: list[int], low: int, high: int) -> list[int]:
        out = []
        while high > low:
            out.append(ends[high - 1])
            high -= self.size[ends[high - 1]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) >= 4096:
            return [t for part in self.stream(piece) for t in part]
        if len(self.states) > self.max_states:
            self.forget()
        state, ends, moves = self.start, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move >> _BITS
            ends.append(move & _LOW)
        return self._back(ends, 0, len(ends))


class Codec:
    """Whole texts to ids and back. Pieces are remembered in two generations of max_pieces each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 200_000):
        self.machine, self.split = Transducer(ranks, max_pieces * 3 // 2), splitter(pattern)
        self.known = Memory(self._piece, max_pieces)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        rank = self.machine.ranks.get(data)  # a token's bytes are encoded by the token itself
        return np.array([rank] if rank is not None else self.machine.encode(data), "<u4").tobytes()

    def forget(self) -> None:
        """Gives up the memory of pieces and states, not the vocabulary."""
        self.known.forget()
        self.machine.forget()

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        known = self.known
        known.turn()
        return b"".join([known[p] for p in self.split(text)])

    def decode_bytes(self, ids: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
        all_ids, of = np.frombuffer(ids, "<u4"), self.machine.bytes.__getitem__
        for i in range(0, len(all_ids), chunk):
            yield b"".join(map(of, all_ids[i : i + chunk].tolist()))

    def decode(self, ids: bytes) -> Iterator[str]:
        return utf8_stream(self.decode_bytes(ids))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str, max_pieces: int) -> Codec:
    """One for each Python worker, so that tasks share the states and pieces it has made."""
    return Codec(read_ranks(path), pattern, max_pieces)


def utf8_stream(chunks: Iterable[bytes]) -> Iterator[str]:
    """Text of byte chunks; bytes of an unfinished character wait for the next chunk, malformed ones become U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for c in chunks:
        yield machine.decode(c)
    yield machine.decode(b"", True)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", digests: bool = False, max_pieces: int = 200_000, remember: bool = True) -> DataFrame:
    """docs without its text, with n_tokens and ids (array of int), or with digests of the ids and of the decoded bytes.

    Workers remember pieces and states from task to task, or with remember off
    for one task at a time; max_pieces bounds that memory and no result.

    A null text counts as empty and has no ids. Repeated rows are each encoded;
    an empty table gives an empty result. Columns named like a result are replaced.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids"]
    kept = [c for c in docs.columns if c != text and c not in new]
    schema = docs.select(*kept).schema.add("n_tokens", "long")
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string") if digests else schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern, max_pieces)
        for batch in sliced(batches):
            n, first, second = [], [], []
            for t in batch.column(len(kept)).to_pylist():
                ids = codec.encode(t or "")
                n.append(len(ids) // 4)
                if digests:
                    decoded = hashlib.sha256()
                    for part in codec.decode(ids):
                        decoded.update(part.encode())
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(decoded.hexdigest())
                else:
                    first.append(np.frombuffer(ids, "<i4"))
            own = [pa.array(first, pa.string()), pa.array(second, pa.string())] if digests else [pa.array(first, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), *own], [*kept, *new])
        if not remember:
            codec.forget()

    return docs.select(*kept, text).mapInArrow(run, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
