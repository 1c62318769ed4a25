"""Exact substring dedup over word windows, by difference-cover anchors.

A window (13 words) is removed from a document if its word sequence also starts in a document with a
smaller doc_id. Two equal windows at positions i and j of their documents have an offset d below 7
with (i + d) mod 7 and (j + d) mod 7 both in the cover {1, 2, 4}: they share an aligned anchor of
13 - 7 + 1 = 7 words there. So

1. only anchors at cover positions are hashed, and anchors that occur in two documents are found;
2. windows that hold such an anchor are candidates (the match extends around the anchor): the hash of all
   13 words is compared, and the smallest doc_id of each window sequence is found;
3. words covered by a window that starts in a smaller document are taken out.

Documents are dealt into blocks by a hash of doc_id; that shuffle is used by all three steps. Steps 1 and 2
send packed arrays from blocks to hash shards - one entry for each sequence and block, so a passage that
a third of all documents share is pre-aggregated in each block - and one bit for each entry comes back.
No pairs are formed and nothing but two sums reaches the driver.

Defined results: bytes of a string that are no UTF-8 become U+FFFD first; null texts have no words; texts of fewer than 13 words lose none; rows without
doc_id are not returned; rows that repeat a doc_id do not remove each other's words (their doc_ids are
equal); in a table without rows the result has none. Anchors compare by 48 bits and the shard (a false
match only adds a candidate), windows by 64 bits within a block of some 2 MB and by 96 bits between blocks, both made of 64-bit hashes
of the words; words are not compared again. The chance of any false match among n windows is about n * (windows a block) / 2**65
within blocks and n**2 / 2**97 between them: 0.2 and 0.001 for 1.6e13 windows, those of some 100 TB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import ship_package

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
BLOCK_BYTES = 2 << 20
SHARD_ENTRIES = 1_500_000
_BASE, _STEP, _STEP2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def hash_words(text: bytes) -> np.ndarray:
    """Hashes of the words of ``text``, whose words have one space between them."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _windows(words: np.ndarray, width: int, step: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on (positions near the end are left out)."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(step)
        out += words[k : k + n]
    return _mix(out)


class Block:
    """The documents of a block in the order of (doc_id, text), and what the three steps derive from them."""

    PIECE = 1 << 17

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        raw = [t or b"" for t in table.column("text").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k], raw[k]))
        self.ids = np.array([ids[k] for k in self.order], np.int64)
        self.texts = [b" ".join(raw[k].split()) for k in self.order]
        self.counts = np.array([t.count(b" ") + 1 if t else 0 for t in self.texts], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        hashes, part, size = [], [], 0
        for t in self.texts:
            if t:
                part.append(t)
                size += len(t)
            if size >= self.PIECE:
                hashes.append(hash_words(b" ".join(part)))
                part, size = [], 0
        hashes.append(hash_words(b" ".join(part)))
        self.words = np.concatenate(hashes)
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)
        self.at = np.arange(len(self.words)) - self.starts[self.doc]
        self.left = self.counts[self.doc] - self.at  # words from here to the document's end

    def anchors(self):
        """Positions of the anchors, their distinct hashes, each position's place among those, and which are in several documents."""
        width = WINDOW - PERIOD + 1
        fits = np.isin(self.at % PERIOD, COVER) & (self.left >= width) & (self.counts[self.doc] >= WINDOW)
        where = np.flatnonzero(fits)
        hashes = _windows(self.words, width, _STEP)[where] if len(where) else np.zeros(0, np.uint64)
        distinct, place = np.unique(hashes, return_inverse=True)
        first = np.full(len(distinct), np.iinfo(np.int64).max)
        last = np.full(len(distinct), np.iinfo(np.int64).min)
        owner = self.ids[self.doc[where]]
        np.minimum.at(first, place, owner)
        np.maximum.at(last, place, owner)
        return where, distinct, place, first != last

    def candidates(self, bits: dict[int, bytes], shards: int):
        """Starts of the candidate windows, their distinct hashes (64 and 32 bits), places and smallest doc_ids."""
        where, distinct, place, repeated = self.anchors()
        repeated = repeated | _returned(distinct, shards, bits)
        marks = np.zeros(len(self.words) + PERIOD + 1, np.int64)
        marks[1:][where] = repeated[place]
        sums = np.cumsum(marks)
        n = len(self.words)
        near = (sums[PERIOD : n + PERIOD] - sums[:n] > 0) & (self.left >= WINDOW) if n else np.zeros(0, bool)
        starts = np.flatnonzero(near)
        if len(starts):
            one, two = _windows(self.words, WINDOW, _STEP)[starts], _windows(self.words, WINDOW, _STEP2)[starts]
        else:
            one = two = np.zeros(0, np.uint64)
        distinct, first, place = np.unique(one, return_index=True, return_inverse=True)
        return starts, distinct, two[first].astype(np.uint32), place, self.ids[self.doc[starts[first]]] if len(starts) else np.zeros(0, np.int64)

    def removed(self, bits: dict[int, bytes], more: dict[int, bytes], shards: int) -> np.ndarray:
        starts, distinct, _, place, smallest = self.candidates(bits, shards)
        elsewhere = _returned(distinct, shards, more)
        gone = starts[elsewhere[place] | (self.ids[self.doc[starts]] > smallest[place])] if len(starts) else starts
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        return np.cumsum(edge)[:-1] > 0


def _returned(distinct: np.ndarray, shards: int, bits: dict[int, bytes]) -> np.ndarray:
    """The bit that came back for each hash; ``bits`` has them by shard, in the order of ``distinct``."""
    out = np.zeros(len(distinct), bool)
    own = distinct % np.uint64(shards)
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.array(sorted(bits), np.uint64)) if bits else []
    for shard, start in zip(sorted(bits), bounds, strict=True):
        got = np.unpackbits(np.frombuffer(bits[shard], np.uint8))
        stop = int(np.searchsorted(own[order], np.uint64(shard), side="right"))
        out[order[start:stop]] = got[: stop - start].astype(bool)
    return out


def _sent(block: int, distinct: np.ndarray, shards: int, parts: list[np.ndarray]) -> pa.Table:
    """One row for each shard: the entries' parts one after the other."""
    own = distinct % np.uint64(shards)
    order = np.argsort(own, kind="stable")
    names, starts = np.unique(own[order], return_index=True)
    stops = np.append(starts[1:], len(order))[: len(starts)]
    blobs = [b"".join(np.ascontiguousarray(p[order[a:b]]).tobytes() for p in parts) for a, b in zip(starts, stops, strict=True)]
    return pa.table(
        {
            "shard": pa.array(names.astype(np.int64)),
            "block": pa.array(np.full(len(names), block, np.int64)),
            "n": pa.array((stops - starts).astype(np.int64)),
            "blob": pa.array(blobs, pa.binary()),
        }
    )


_ENTRIES = "shard long, block long, n long, blob binary"
_BITS = "block long, shard long, bits binary"


def _back(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "bits": pa.array(bits, pa.binary())})


def _vote_anchors(table: pa.Table) -> pa.Table:
    """An entry's bit is set if another block has the same anchor."""
    sizes, blobs = table.column("n").to_pylist(), table.column("blob").to_pylist()
    raw = np.zeros((sum(sizes), 8), np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    _, place, counts = np.unique(raw.view("<u8")[:, 0], return_inverse=True, return_counts=True)
    return _back(table, counts[place] > 1, sizes)


def _vote_windows(table: pa.Table) -> pa.Table:
    """An entry's bit is set if another block has the same window in a smaller document."""
    sizes, blobs = table.column("n").to_pylist(), table.column("blob").to_pylist()
    one = np.concatenate([np.frombuffer(b, "<u8", n) for n, b in zip(sizes, blobs, strict=True)])
    two = np.concatenate([np.frombuffer(b, "<u4", n, 8 * n) for n, b in zip(sizes, blobs, strict=True)])
    ids = np.concatenate([np.frombuffer(b, "<i8", n, 12 * n) for n, b in zip(sizes, blobs, strict=True)])
    order = np.lexsort((ids, two, one))
    a, b, c = one[order], two[order], ids[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    first = c[np.flatnonzero(new)][np.cumsum(new) - 1]
    flags = np.zeros(len(order), bool)
    flags[order] = c > first
    return _back(table, flags, sizes)


def _by_shard(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("shard").to_pylist(), table.column("bits").to_pylist(), strict=True))


def remove_repeats(docs: DataFrame, *, keep: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """One row per document: doc_id, ``keep``, n_words, n_removed, kept (the kept words, one space between them).

    ``untouched``: texts that lose no word are returned as they were, with their own white space.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").cast("binary").alias("text"), *keep)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))  # rows sent: one for each block and shard at most
    blocks, shards = max(least, size // BLOCK_BYTES), max(least, size // (12 * SHARD_ENTRIES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def send_anchors(table: pa.Table) -> pa.Table:
        _, distinct, _, _ = Block(table).anchors()
        high = np.ascontiguousarray(distinct).view(np.uint8).reshape(-1, 8)[:, 2:]
        return _sent(table.column("block")[0].as_py(), distinct, shards, [high])

    def send_windows(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, np.zeros(0, np.uint64), shards, [])
        _, distinct, two, _, smallest = Block(table).candidates(_by_shard(bits), shards)
        return _sent(table.column("block")[0].as_py(), distinct, shards, [distinct, two, smallest])

    def finish(table: pa.Table, bits: pa.Table) -> pa.Table:
        block = Block(table)
        first = bits.filter(pa.compute.equal(bits.column("step"), 1))
        second = bits.filter(pa.compute.equal(bits.column("step"), 2))
        gone = block.removed(_by_shard(first), _by_shard(second), shards)
        n_removed, kept = [], []
        sorted_rows = table.take(pa.array(block.order, pa.int64()))
        raw = sorted_rows.column("text").to_pylist() if untouched else block.texts
        for text, before, start, n in zip(block.texts, raw, block.starts, block.counts, strict=True):
            own = gone[start : start + n]
            out = int(own.sum())
            n_removed.append(out)
            kept.append((before or b"") if not out else b" ".join(w for w, g in zip(text.split(b" "), own, strict=True) if not g) if out < n else b"")
        own = {"doc_id": pa.array(block.ids)} | {k: sorted_rows.column(k) for k in keep}
        return pa.table(own | {"n_words": pa.array(block.counts), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    anchors = dealt.groupBy("block").applyInArrow(send_anchors, _ENTRIES)
    bits = anchors.groupBy("shard").applyInArrow(_vote_anchors, _BITS)
    windows = dealt.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(send_windows, _ENTRIES)
    more = windows.groupBy("shard").applyInArrow(_vote_windows, _BITS)
    both = bits.withColumn("step", F.lit(1)).union(more.withColumn("step", F.lit(2)))
    fields = ", ".join(["doc_id long", *(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep), "n_words long, n_removed long, kept string"])

    def finish_group(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: table.column(k) for k in ("doc_id", *keep)} | {"n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        return finish(table, found)

    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish_group, fields)
