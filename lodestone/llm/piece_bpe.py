"""SentencePiece (merge type) encoding and decoding by a table of prefixes.

Of every prefix of a text the encoding ends in exactly one token, and what stands before that token is the encoding of the shorter
prefix. So one pass over the text fills a table with the last token of each prefix: an Aho-Corasick automaton names the pieces that end
at a place, longest first, and the one whose start's own last token may stand before it is stored; a single character is left where none
fits. The ids are then recovered backwards from the end. Whether two pieces may stand side by side is decided once a pair, by
merging their characters alone (``PieceGraph.adjacent``).

The text is taken as the model's normaliser gives it (a space is U+2581, and one stands before a text that is not empty). Where no piece
of the vocabulary has U+2581 after another character, tokens never reach over the start of a run of them, so the
words between are encoded apart, equal ones once; otherwise a whole text is one word. Characters without a piece become byte ids.

Decoding joins the pieces' characters, drops begin and end ids and the first space, and reads runs of byte ids as UTF-8 in which each
byte that does not fit becomes U+FFFD.

Defined results: a null text counts as empty (begin and end ids only, decoded as the empty text); bytes of a string that are no UTF-8
become U+FFFD first; repeated rows are encoded each; texts and words of any length are processed whole, in memory that follows the longest one.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.packed import PieceTable, taken
from lodestone.runtime import ship_package

SPACE = "▁"
UNKNOWN = " ⁇ "  # what an unknown id decodes to
MAX_PAIRS, MAX_WORDS, MAX_IDS = 400_000, 400_000, 4_000_000
ROWS = 400
_PROBE = "  ﬁ Ａé\t x\n "
codecs.register_error("lodestone-each-byte", lambda e: ("�", e.start + 1))


class PieceGraph:
    """The pieces that merging can make, an automaton that finds them, and which may stand side by side.

    ``scores``: piece to score; of two neighbours whose concatenation is a piece, those with the highest score merge first, the
    leftmost of equals.
    """

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.scores = scores
        self._adjacent: dict[tuple[str, str], bool] = {}
        self.find = ahocorasick.Automaton()
        for piece in scores:
            if len(piece) > 1 and self.merged(piece) == [piece]:  # others never come out of merging
                self.find.add_word(piece, piece)
        self.find.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merges as they are defined; for texts of a few characters."""
        parts, score_of = list(text), self.scores.get
        pairs = [score_of(a + b) for a, b in pairwise(parts)]
        while True:
            best, at = None, -1
            for k, score in enumerate(pairs):
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score_of(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = score_of(parts[at] + parts[at + 1])

    def adjacent(self, left: str, right: str) -> bool:
        key = left, right
        fits = self._adjacent.get(key)
        if fits is None:
            if len(self._adjacent) >= MAX_PAIRS:
                self._adjacent.clear()
            fits = self._adjacent[key] = self.merged(left + right) == [left, right]
        return fits

    def last_pieces(self, word: str) -> list[str]:
        """For each prefix of ``word``, the last piece of its encoding (at 0: nothing)."""
        last, adjacent = ["", *word], self.adjacent
        done = 0  # the longest prefix whose last piece has been found by the automaton
        for end, piece in self.find.iter(word):
            if end + 1 == done:
                continue
            start = end + 1 - len(piece)
            if not start or adjacent(last[start], piece):
                done = end + 1
                last[done] = piece
        return last

    def encode(self, word: str) -> list[str]:
        last, at, out = self.last_pieces(word), len(word), []
        while at:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return out


class Codec:
    """Texts to ids and back, as the library's ``encode`` (with begin and end ids, no sampling) and ``decode``."""

    def __init__(self, path: str, max_words: int = MAX_WORDS, max_ids: int = MAX_IDS):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.id_of = {model.id_to_piece(k): k for k in ids if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))}
        self.byte_id = {int(model.id_to_piece(k)[3:5], 16): k for k in ids if model.is_byte(k)}
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.graph = PieceGraph({piece: model.get_score(k) for piece, k in self.id_of.items() if not model.is_unused(k)})
        self.plain = model.normalize(_PROBE) == (SPACE + _PROBE).replace(" ", SPACE)
        whole = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.id_of)
        self.split = (lambda text: [text] if text else []) if whole else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.words = PieceTable(lambda words: list(map(self._word, words)), max_words, max_ids)
        surface = [self._surface(k) for k in ids]
        self.surface, self.surface_ends = np.frombuffer(b"".join(surface), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, surface)))))
        self.is_byte = np.array([model.is_byte(k) for k in ids])
        self.visible = np.array([not model.is_control(k) for k in ids])
        self.spaced = np.array([model.id_to_piece(k).startswith(SPACE) for k in ids])

    def _word(self, word: str) -> list[int]:
        out, id_of, byte_id = [], self.id_of.get, self.byte_id
        for piece in self.graph.encode(word):
            k = id_of(piece)
            if k is not None:
                out.append(k)
            else:
                out += [byte_id[b] for b in piece.encode()] if byte_id else [self.unknown]
        return out

    def _surface(self, k: int) -> bytes:
        if self.model.is_control(k):
            return b""
        if self.model.is_unknown(k):
            return UNKNOWN.encode()
        piece = self.model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace(SPACE, " ").encode()

    def normal(self, text: str) -> str:
        if not self.plain:
            return self.model.normalize(text)
        return (SPACE + text).replace(" ", SPACE) if text else ""

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, with begin and end ids, one after the other, and each text's number of them."""
        found = [self.split(self.normal(text)) for text in texts]
        flat, lengths = self.words.look_up(pa.array(list(chain.from_iterable(found)), pa.large_string()))
        bounds = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *map(len, found)])]
        counts = np.diff(bounds) + 2
        ids = np.empty(len(flat) + 2 * len(texts), np.int32)
        ends = np.cumsum(counts)
        ids[ends - counts], ids[ends - 1] = self.begin, self.end
        inner = np.ones(len(ids), bool)
        inner[ends - counts] = inner[ends - 1] = False
        ids[inner] = flat
        return ids, counts

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8."""
        raw, lengths = taken(self.surface, self.surface_ends, ids)
        out = raw.tobytes()
        seen = np.flatnonzero(self.visible[ids])
        if not len(seen):
            return b""
        first = int(ids[seen[0]])
        skip = int(self.spaced[first])
        of_bytes = self.is_byte[ids]
        if of_bytes.any():
            whole = self.visible[ids[1:-1]].all()  # a begin or end id between byte ids parts them
            try:
                whole and out.decode()
            except UnicodeDecodeError:
                whole = False
            if not whole:  # each run of byte ids for itself
                edges = np.flatnonzero(np.diff(np.concatenate(([0], of_bytes.astype(np.int8), [0]))))
                ends = np.concatenate(([0], np.cumsum(lengths)))
                cuts = [0, *ends[edges].tolist(), len(out)]
                out = b"".join(out[a:b].decode("utf-8", "lodestone-each-byte" if k % 2 else "strict").encode() for k, (a, b) in enumerate(pairwise(cuts)))
        return out[skip:]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, np.int64)).decode()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, one for each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, *, ids: bool = True, digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens; with ``ids`` the array, with ``digests`` the SHA-256 of the ids as little-endian unsigned
    32-bit integers and of the text that they decode to.

    ``path``: the model file on every executor. ``keep`` names further columns of ``docs`` to carry along.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat, lengths = own.encode_all([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                columns, names = [*part.columns[:-1], pa.array(lengths, pa.int64())], [*part.schema.names[:-1], "n_tokens"]
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
                    names.append("ids")
                if digests:
                    each = [flat[a:b] for a, b in pairwise(offsets.tolist())]
                    columns.append(pa.array([hashlib.sha256(x.astype("<u4", copy=False).tobytes()).hexdigest() for x in each], pa.string()))
                    columns.append(pa.array([hashlib.sha256(own.decode_bytes(x)).hexdigest() for x in each], pa.string()))
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = docs.select("doc_id", *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["n_tokens long"]
    fields += ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests
    return docs.select("doc_id", *keep, F.make_valid_utf8("text").alias("__text")).mapInArrow(run, ", ".join(fields))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids decode to the empty text."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
