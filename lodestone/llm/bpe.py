"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

A merge table compiles into an automaton over bytes. Its non-deterministic form starts a token at
any position and follows the trie of token bytes; a token may follow another only if the merges
keep the two apart, which is decided once a pair (``TokenGraph.adjacent``). For every prefix of a
piece exactly one chain of such tokens ends at its end, and the chain of the whole piece is the
piece's encoding. A deterministic state is the set of positions where a longer token can still
start, each with its trie node and what it has to remember of the token before it; states are built when they
are first reached, and every state names the token that ends there. What the chains of all live starts share is emitted,
so the delay is bounded by the longest token's length.

Decoding looks ids up and feeds the bytes through an incremental UTF-8 state machine, so ids may
come in any portions.

Defined results: null text encodes as the empty text (no ids); bytes of a string that are no UTF-8 become U+FFFD first; repeated rows are encoded each; text
of any length is processed whole, piece by piece.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.packed import taken
from lodestone.runtime import ship_package

MAX_CELLS = 12_000_000  # four bytes each
MAX_PAIRS = 250_000
SMALL_SUBTREE = 16
ROWS = 200


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class TokenGraph:
    """The tokens' trie and which tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        for raw, rank in ranks.items():
            node = 0
            for byte in raw:
                below = self.children[node].get(byte)
                if below is None:
                    below = self.children[node][byte] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.token[node] = rank
        self.beneath = [0] * len(self.token)  # tokens below each node, which has a smaller number than they
        for node in range(len(self.token) - 1, -1, -1):
            self.beneath[node] = sum(self.beneath[x] + (self.token[x] >= 0) for x in self.children[node].values())
        self.bytes_of = {rank: raw for raw, rank in ranks.items()}
        self.length_of = {rank: len(raw) for raw, rank in ranks.items()}
        self._adjacent: dict[tuple[int, int], bool] = {}
        self._reach: dict[tuple[int, int], int | None] = {}
        self._seams: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}

    def _halves(self, raw: bytes) -> list[bytes]:
        """The last two parts of a token before its final merge: pairs of lowest rank first, the leftmost first."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            i = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _seam(self, token: int, at_end: bool) -> list[tuple[bytes, float]]:
        """The parts that lie at a token's end (or start) while it is merged, each with the rank that ends it."""
        known = self._seams.get((token, at_end))
        if known is None:
            raw, until, known = self.bytes_of[token], float("inf"), []
            while True:
                known.append((raw, until))
                if len(raw) == 1:
                    break
                until = self.ranks[raw]
                raw = self._halves(raw)[-1 if at_end else 0]
            known.reverse()
            self._seams[token, at_end] = known
        return known

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the merges keep both tokens: no two parts that meet at the seam merge before a part grows.

        Of equal ranks the leftmost pair merges first: growth of the left part, then the seam, then the right part.
        """
        fits = self._adjacent.get((left, right))
        if fits is None:
            a, b, i, j, fits = self._seam(left, True), self._seam(right, False), 0, 0, True
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                rank = self.ranks.get(x + y)
                if rank is not None and rank < x_until and rank <= y_until:
                    fits = False
                    break
                if x_until <= y_until:
                    if i + 1 == len(a):
                        break
                    i += 1
                else:
                    j += 1
            if len(self._adjacent) >= MAX_PAIRS:
                self._adjacent.clear()
            self._adjacent[left, right] = fits
        return fits

    def reach(self, node: int, before: int) -> int | None:
        """What a start at ``node`` has to remember of the token before it: nothing (-1) where that token fits every token below
        the node; None where it fits none, so that the start is dead. Only small subtrees are looked through."""
        if before < 0 or self.beneath[node] > SMALL_SUBTREE:
            return before
        key = node, before
        if key in self._reach:
            return self._reach[key]
        fits, misses, waiting = 0, 0, list(self.children[node].values())
        while waiting and not (fits and misses):
            at = waiting.pop()
            if self.token[at] >= 0:
                good = self.adjacent(before, self.token[at])
                fits, misses = fits + good, misses + (not good)
            waiting += self.children[at].values()
        out = before if fits and misses else -1 if fits else None
        if len(self._reach) >= MAX_PAIRS:
            self._reach.clear()
        self._reach[key] = out
        return out


class Transducer:
    """Deterministic steps over bytes, made when first needed and kept in one flat table of integers.

    A state lists the live starts of tokens, each as (trie node its bytes have led to, what it remembers of the token before it);
    its last entry is the end of what has been read, with the token that ends there. Short pieces take their steps
    side by side, one array operation for a byte of each. In a long piece the tokens that all live starts share are emitted every PORTION
    bytes; no start stays live for longer than the longest token, which bounds the delay. A full table
    is made anew from the states in use.
    """

    PORTION = 256
    WIDTH = 64  # bytes seen so far have a column each; the table is widened when there are more

    def __init__(self, graph: TokenGraph, max_cells: int = MAX_CELLS):
        self.graph, self.max_cells = graph, max_cells
        self.lengths = np.zeros(max(graph.bytes_of) + 1, np.int64)
        for token, n in graph.length_of.items():
            self.lengths[token] = n
        self.column = np.full(256, -1, np.int64)
        self.bytes: list[int] = []  # of each column
        self.width = self.WIDTH
        self.start()

    def start(self) -> None:
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.ends = np.zeros(1024, np.int32)
        self.table = np.full((1024, self.width), -1, np.int32)
        self.first = self._name(((0, -1),))

    def _name(self, state: tuple) -> int:
        known = self.names.setdefault(state, len(self.states))
        if known == len(self.states):
            self.states.append(state)
            if known == len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
                self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
            self.ends[known] = state[-1][1]
        return known

    def _columns(self, raw: np.ndarray) -> None:
        """Gives each byte of ``raw`` a column."""
        for byte in np.flatnonzero(np.bincount(raw, minlength=256) * (self.column < 0)).tolist():
            self.column[byte] = len(self.bytes)
            self.bytes.append(byte)
        if len(self.bytes) > self.width:
            self.table = np.pad(self.table, ((0, 0), (0, self.width)), constant_values=-1)
            self.width *= 2
            self._columns(raw[:0])

    def _step(self, name: int, column: int) -> int:
        children, tokens, adjacent, reach = self.graph.children, self.graph.token, self.graph.adjacent, self.graph.reach
        byte, live, whole = self.bytes[column], [], None
        for node, before in self.states[name]:
            below = children[node].get(byte)
            if below is None:
                continue
            if whole is None and (token := tokens[below]) >= 0 and (before < 0 or adjacent(before, token)):
                whole = token
            if children[below] and (kept := reach(below, before)) is not None:
                live.append((below, kept))
        if whole is None:
            raise ValueError("the merge table has no token for a byte")
        live.append((0, whole))
        after = self._name(tuple(live))
        self.table[name, column] = after
        return after

    def _made_anew(self, states: np.ndarray) -> np.ndarray:
        """The states, under their new names where the table was full."""
        if len(self.states) * self.width <= self.max_cells:
            return states
        old, (used, at) = self.states, np.unique(states, return_inverse=True)
        self.start()
        return np.array([self._name(old[k]) for k in used.tolist()], np.int64)[at]

    def encode_all(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces ``raw[offsets[k] : offsets[k + 1]]`` one after the other, and the end of each piece's tokens, from 0."""
        begins, sizes = offsets[:-1], np.diff(offsets)
        long = np.flatnonzero(sizes > self.PORTION)
        rows = np.argsort(-sizes, kind="stable")[len(long) :]
        rows = rows[sizes[rows] > 0]
        self._columns(raw)
        last = np.zeros(len(raw), np.int32)  # for each byte, the token that ends there
        states, own = np.full(len(rows), self.first, np.int64), begins[rows]
        for k in range(int(sizes[rows[0]]) if len(rows) else 0):
            m = int(np.searchsorted(-sizes[rows], -k))  # rows of more than k bytes
            states = self._made_anew(states[:m])
            columns = self.column[raw[own[:m] + k]]
            after = self.table[states, columns].astype(np.int64)
            missing = np.flatnonzero(after < 0)
            if len(missing):
                ask, at = np.unique(states[missing] * self.width + columns[missing], return_inverse=True)
                after[missing] = np.array([self._step(*divmod(x, self.width)) for x in ask.tolist()], np.int64)[at]
            states = after
            last[own[:m] + k] = self.ends[states]
        rounds, at = [], begins[rows] + sizes[rows]
        left, counts = np.arange(len(rows)), np.zeros(len(sizes), np.int64)
        while len(left):
            tokens = last[at[left] - 1]
            rounds.append((rows[left], tokens))
            at[left] -= self.lengths[tokens]
            counts[rows[left]] += 1
            left = left[at[left] > own[left]]
        apart = {k: self.encode(raw[begins[k] : begins[k] + sizes[k]].tobytes()) for k in long.tolist()}
        for k, ids in apart.items():
            counts[k] = len(ids)
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = np.zeros(int(ends[-1]), np.int32)
        for k, (some, tokens) in enumerate(rounds):
            out[ends[some + 1] - 1 - k] = tokens
        for k, ids in apart.items():
            out[ends[k] : ends[k + 1]] = ids
        return out, ends

    def encode(self, raw: bytes) -> list[int]:
        """Tokens of one piece of any length, as a stream."""
        ids: list[int] = []
        last: list[int] = []  # for each byte read and not yet emitted, the token that ends there
        self._columns(np.frombuffer(raw, np.uint8))
        columns, state = self.column.tolist(), int(self._made_anew(np.array([self.first]))[0])
        for at in range(0, len(raw), self.PORTION):
            if at:
                self._emit(state, last, ids)
                state = int(self._made_anew(np.array([state]))[0])
            for byte in raw[at : at + self.PORTION]:
                after = int(self.table[state, columns[byte]])
                state = after if after >= 0 else self._step(state, columns[byte])
                last.append(int(self.ends[state]))
        return ids + self._tokens(last, len(last))

    def _tokens(self, last: list[int], at: int) -> list[int]:
        out, length_of = [], self.graph.length_of
        while at > 0:
            token = last[at - 1]
            out.append(token)
            at -= length_of[token]
        out.reverse()
        return out

    def _emit(self, state: int, last: list[int], ids: list[int]) -> None:
        """Moves the tokens that the chains of all live starts share from ``last`` to ``ids``."""
        paths = [self._tokens(last, len(last) - self.graph.depth[node]) for node, _ in self.states[state]]
        same = next((k for k, at in enumerate(zip(*paths, strict=False)) if len(set(at)) > 1), min(map(len, paths)))
        ids += paths[-1][:same]
        del last[: sum(map(self.graph.length_of.__getitem__, paths[-1][:same]))]


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(TokenGraph(ranks))
        self.find = regex.compile(pattern).findall
        self.bytes_of = self.transducer.graph.bytes_of

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other and each text's number of them. Equal pieces are encoded once."""
        found = [self.find(text) if text else [] for text in texts]
        pieces = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        _, bounds, raw = pieces.dictionary.buffers()
        offsets = np.frombuffer(bounds, np.int32)[: len(pieces.dictionary) + 1].astype(np.int64)
        ids, ends = self.transducer.encode_all(np.frombuffer(raw or b"", np.uint8)[: offsets[-1]], offsets)
        ids, lengths = taken(ids, ends, pieces.indices.to_numpy())
        return ids, np.diff(np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *map(len, found)])])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class StreamDecoder:
    """Ids in portions of any size; each call returns the characters completed so far."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), final)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, one for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *, ids: bool = True, digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens; with ``ids`` the array, with ``digests`` the SHA-256 of the
    decimal ids joined by commas and of the bytes that the ids decode to.

    ``path``: the vocabulary's rank file on every executor; ``pattern``: the pretokenisation. ``keep``
    names further columns of ``docs`` to carry along.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimal = {rank: b"%d" % rank for rank in own.bytes_of}.__getitem__ if digests else None
        for batch in batches:
            n = batch.num_rows
            for at in range(0, n, ROWS):
                part = batch.slice(at, ROWS)
                flat, lengths = own.encode_all(part.column(part.num_columns - 1).to_pylist())
                columns, names = [*part.columns[:-1], pa.array(lengths, pa.int64())], [*part.schema.names[:-1], "n_tokens"]
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
                    names.append("ids")
                if digests:
                    each = [flat[a:b].tolist() for a, b in pairwise(offsets.tolist())]
                    columns.append(pa.array([hashlib.sha256(b",".join(map(decimal, x))).hexdigest() for x in each], pa.string()))
                    columns.append(pa.array([_decoded_digest(own, x) for x in each], pa.string()))
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = docs.select("doc_id", *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["n_tokens long"]
    fields += ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests
    return docs.select("doc_id", *keep, F.make_valid_utf8("text").alias("__text")).mapInArrow(run, ", ".join(fields))


def _decoded_digest(own: Codec, ids: list[int], portion: int = 4096) -> str:
    """Streaming decode: the state machine holds back the bytes of an unfinished character."""
    stream, out = StreamDecoder(own.bytes_of), hashlib.sha256()
    for at in range(0, len(ids), portion):
        out.update(stream.feed(ids[at : at + portion]).encode())
    out.update(stream.feed((), True).encode())
    return out.hexdigest()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; bytes that are no UTF-8 become U+FFFD."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, r"(?s).+")
        for batch in batches:
            texts = [StreamDecoder(own.bytes_of).feed(x or (), True) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
