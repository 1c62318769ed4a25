"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on the document id.

Documents are range-partitioned on doc_id, encoded after that shuffle (so each text moves once and
its ids never do) and written in ascending order; readers can take stripes in parallel, and skip
stripes and row groups by the index and the Bloom filter.

Each row also says its part (the range it is in) and the ids before it in that part, so a document's place in the whole needs the parts'
totals only.

Words are encoded by the tokenizers library once each and kept in a bounded table: with this form of tokenizer (``WORDWISE``) the
pretokeniser drops white space and never joins across it, the normaliser lower-cases letter by letter, and marks compose
with letters of their own word only, so a text's ids are its words' ids in order. Texts that hold an added token's string, and all
texts of a tokenizer of another form, go through the library whole.

Defined results: bytes of a string that are no UTF-8 become U+FFFD first; null text has only the end id; an empty table gives an empty result; equal doc_ids
are ordered by a hash of their texts; a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.packed import PieceTable
from lodestone.runtime import materialize, ship_package

MAX_WORDS, MAX_IDS = 600_000, 4_000_000
ROWS = 400
STRIPE_BYTES = 16 << 20
PART_BYTES = 256 << 20  # of text
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
_COMBINING = "[\u0300-\u036f]"  # the marks that compose with ASCII letters

# fixed values: the settings of a vocabulary file under which words are encoded apart
WORDWISE = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def _byte_characters() -> dict[int, str]:
    """Byte-level pretokenisers show a printable Latin-1 byte as itself and the others, in order, from U+0100 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_CHARACTERS = _byte_characters()


class TextEncoder:
    """The library's plain call, ``encode(text, add_special_tokens=False)``, for many texts."""

    def __init__(self, path: str, max_words: int = MAX_WORDS, max_ids: int = MAX_IDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.wordwise = all(settings.get(k) == v for k, v in WORDWISE.items()) and settings["model"].get("type") == "BPE" and not settings["model"].get("dropout")
        added = [re.escape(t["content"]) for t in settings.get("added_tokens", [])]
        self.added = "(?i)" + "|".join(added) if added else None
        self.words = PieceTable(self._encode, max_words, max_ids)

    def _encode(self, words: list[str]) -> list[list[int]]:
        """Small Latin letters are one piece that the normaliser leaves alone, so the model takes them
        as they are, each byte as the pretokeniser's character for it; other words go through the whole pipeline."""
        model, out, other = self.tokenizer.model.tokenize, [], []
        for k, w in enumerate(words):
            if _LETTERS(w):
                out.append([t.id for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARACTERS))])
            else:
                out.append(())
                other.append(k)
        for k, found in zip(other, self._library([words[k] for k in other]), strict=True):
            out[k] = found
        return out

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other and each text's number of them; null counts as empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.added) if self.added else pa.array(np.zeros(len(texts), bool))
        if not self.wordwise:
            whole = pa.array(np.ones(len(texts), bool))
        small = pc.if_else(pc.match_substring_regex(texts, _COMBINING), texts, pc.ascii_lower(texts))
        # a letter's full stop or comma before white space is a piece of its own
        apart = pc.replace_substring_regex(pc.if_else(whole, "", small), r"([a-z])([.,])(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(apart)
        ids, lengths = self.words.look_up(split.flatten())
        bounds = split.offsets.to_numpy()
        ends = np.concatenate(([0], np.cumsum(lengths)))[bounds - bounds[0]]
        counts = np.diff(ends)
        if pc.any(whole).as_py():
            each, at = np.split(ids, ends[1:-1]), np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            for k, found in zip(at.tolist(), self._library(texts.take(pa.array(at)).to_pylist()), strict=True):
                each[k] = np.array(found, np.int32)
                counts[k] = len(found)
            ids = np.concatenate(each)
        return ids, counts


_ENCODERS: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


_SCHEMA = "doc_id long, tokens array<int>, part int, at long"


def encode(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """doc_id, tokens (the ids of each text and ``end_id`` after them), part (the partition), at (ids before it in the partition)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, k = text_encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                ids, lengths = own.encode_all(part.column(1))
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), tokens, pa.array(np.full(part.num_rows, k, np.int32)), pa.array(offsets[:-1] + at, pa.int64())], names=["doc_id", "tokens", "part", "at"])
                at += int(offsets[-1])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def write(docs: DataFrame, path: str, out: str, end_id: int = 2, files: int | None = None, stride: int = 10_000) -> None:
    """Write the token files under ``out``: as many as shuffle partitions, or more so that none has much over PART_BYTES of text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text"))
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ordered = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    (
        encode(ordered, path, end_id)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(out)
    )


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, tokens, part, at: filters on doc_id prune stripes and row groups."""
    return spark.read.schema(_SCHEMA).orc(out)


def offsets(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from ``read``'s rows: the totals of the parts before, and the place in the own part.

    The totals are one row a part. A part whose rows do not add up to its last place is an error.
    """
    ship_package(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, bounds = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    rows = materialize(tokens.select("doc_id", "tokens", "part", "at").mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long"), "token-lengths")
    total = F.sum("n_tokens")
    totals = rows.groupBy("part").agg(F.when(total == F.max(F.col("at") + F.col("n_tokens")), total).otherwise(F.raise_error(F.lit("a part lacks rows"))).alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32")
