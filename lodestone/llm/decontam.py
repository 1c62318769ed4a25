"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Text is normalised by bytes: A-Z become a-z, every other ASCII byte outside 0-9 and a-z becomes a
space, bytes of non-ASCII characters stay. Words are the runs between spaces. Each window of
``window`` consecutive item words (or a whole shorter item) is one pattern, delimited by spaces so
that it matches at word bounds only. Each text is scanned once; a match's end offset leads to the
words it covers and, through the word offsets, to the place in the original text. Items of more than SHARD_BYTES are dealt to several automata, which scan
only the texts that a sieve of all windows' hashes leaves, and whose spans and items are merged.

Defined results: null or wordless texts have no words and no hits; null items and wordless items
have no window; equal windows of several items count for each of them; repeated rows are scanned
each; extra columns of ``docs`` pass through ``annotate`` only where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.substring import _STEP, _windows, hash_words
from lodestone.runtime import discard, materialize, ship_package

WINDOW = 10
SHARD_BYTES = 512 << 10  # of items in one automaton: some 400 bytes of it for each, since a word stands in ten windows

MAX_WINDOWS = 16_000_000  # of some 90 MB of items

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_AUTOMATON: list = []  # of the latest items, kept by a Python worker between tasks


def words(raw: bytes) -> list[bytes]:
    """Normalised words of UTF-8 ``raw``."""
    return raw.translate(_FOLD).split()


def item_windows(raw: bytes, window: int) -> list[list[bytes]]:
    w = words(raw)
    if not w:
        return []
    return [w[i : i + window] for i in range(max(1, len(w) - window + 1))]


def build_automaton(items: list[tuple[int, bytes]], window: int):
    """Automaton over all windows; the value of a pattern is (number of words, item ids)."""
    patterns: dict[bytes, tuple[int, set[int]]] = {}
    for item_id, raw in items:
        for w in item_windows(raw, window):
            patterns.setdefault(b" ".join(w), (len(w), set()))[1].add(item_id)
    automaton = ahocorasick.Automaton()
    for key, (n, ids) in patterns.items():
        automaton.add_word(" " + key.decode("latin-1") + " ", (n, frozenset(ids)))
    if patterns:
        automaton.make_automaton()
    return automaton, bool(patterns)


def cached_automaton(items: list[tuple[int, bytes]], window: int):
    if not _AUTOMATON or _AUTOMATON[0] != (items, window):
        _AUTOMATON[:] = [(items, window), build_automaton(items, window)]
    return _AUTOMATON[1]


def scan(raw: bytes, automaton, usable: bool) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(number of words, merged spans of hit words as [first, last), ids of the items that occur)."""
    w = words(raw)
    if not w or not usable:
        return len(w), [], set()
    text = " " + b" ".join(w).decode("latin-1") + " "
    found = list(automaton.iter(text))
    if not found:
        return len(w), [], set()
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)  # offset of the space after each word
    last = np.searchsorted(ends, np.fromiter((e for e, _ in found), np.int64, len(found)))
    spans: list[list[int]] = []
    ids: set[int] = set()
    for stop, start, of in sorted((int(k) + 1, int(k) + 1 - v[0], v[1]) for k, (_, v) in zip(last, found, strict=True)):
        ids |= of
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append([start, stop])
    return len(w), [(a, b) for a, b in spans], ids


def original_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original text that the word ``spans`` cover."""
    if not spans:
        return []
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8)
    edge = np.diff(np.concatenate(([0], (folded != 32).view(np.int8), [0])))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(first[a]), int(stop[b - 1])) for a, b in spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap that cover the same."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def annotate(docs: DataFrame, items: DataFrame, window: int = WINDOW, *, keep: tuple[str, ...] = (), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (byte ranges of the original), items (sorted ids, as strings if they are no integers).

    The items are a benchmark, small by nature: one automaton holds at most about ``shard_bytes`` of them. With more, the texts are read
    twice (and never written): a sieve of all items' windows by their hashes gives the texts without any their result, and keeps those that can have one. Only these few
    are then scanned by an automaton for each shard of the items, each pass handing its findings to the next one through a table.
    ``keep`` names further columns of ``docs`` to carry along.
    """
    spark = docs.sparkSession
    ship_package(spark)
    whole = dict(items.dtypes)["item_id"] in ("tinyint", "smallint", "int", "bigint")
    kind = "long" if whole else "string"
    items = items.select(F.col("item_id").cast(kind).alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    rows = docs.select("doc_id", *keep, F.col("text").cast("binary").alias("__raw"))
    if shards == 1:
        return _scanned(rows, items, window, kind, first=True, last=True)
    sieved = _sieved(rows, items, window)
    columns = ["doc_id", *keep]
    none = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans"), F.array().cast(f"array<{kind}>").alias("items")]
    clean = sieved.where("not __held").select(*columns, F.col("__words").alias("n_words"), *none)
    rows = materialize(sieved.where("__held").drop("__words", "__held"), "decontamination")
    for shard in range(shards):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        before, rows = rows, _scanned(rows, some, window, kind, first=shard == 0, last=shard + 1 == shards)
        if shard + 1 < shards:
            rows = materialize(rows, "decontamination")
            discard(before)
    return clean.unionByName(rows)


def _sieved(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``rows`` and __words (their number), __held: whether a text has a window whose 64-bit hash is that of an item's. The items' hashes are
    eight bytes a window; more than MAX_WINDOWS are an error."""
    spark = rows.sparkSession
    ship_package(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                w = words(raw)
                width = min(window, len(w))
                if width:
                    found = np.unique(_windows(hash_words(b" ".join(w)), width, _STEP))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), width, np.int32)), pa.array(found.view(np.int64))], names=["width", "hash"])

    hashes = materialize(items.select("text").mapInArrow(cut, "width int, hash long").distinct(), "item-windows")
    if hashes.count() > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} different windows of items")
    table = hashes.toArrow()
    widths, found = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast({int(k): np.sort(found[widths == k]) for k in np.unique(widths)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            counts, held = [], []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                w = words(raw or b"")
                hashed = hash_words(b" ".join(w))
                counts.append(len(w))
                held.append(any(_any_in(_windows(hashed, width, _STEP), own) for width, own in known.items()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(held, pa.bool_())], names=[*batch.schema.names, "__words", "__held"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, __words long, __held boolean")


def _any_in(hashes: np.ndarray, known: np.ndarray) -> bool:
    if not len(hashes):
        return False
    return bool((known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes).any())


def _scanned(rows: DataFrame, items: DataFrame, window: int, kind: str, *, first: bool, last: bool) -> DataFrame:
    """One pass of one automaton: what it finds joins what earlier passes found (__spans, __items), and the last pass gives the result's columns."""
    arrow = pa.int64() if kind == "long" else pa.string()
    own = [c for c in rows.columns if c not in ("__raw", "__spans", "__items")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema.fields)
    sent = rows.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1])) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, usable = cached_automaton(sent.value, window)
        for batch in batches:
            n_words, n_hit, spans, ids = [], [], [], []
            n = batch.num_rows
            before = zip(batch.column("__spans").to_pylist(), batch.column("__items").to_pylist(), strict=True) if not first else [((), ())] * n
            for raw, (old, known) in zip(batch.column("__raw").to_pylist(), before, strict=True):
                count, hit, of = scan(raw or b"", automaton, usable)
                hit = merged([*hit, *((x["start"], x["stop"]) for x in old)]) if old else hit
                n_words.append(count)
                n_hit.append(sum(b - a for a, b in hit))
                places = original_spans(raw, hit) if hit and last else hit
                spans.append([{"start": a, "stop": b} for a, b in places])
                ids.append(sorted(of.union(known)))
            found = [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(ids, pa.list_(arrow))]
            kept = [batch.column(c) for c in own]
            if last:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), *found], names=[*own, "n_words", "n_hit", "spans", "items"])
            else:
                yield pa.RecordBatch.from_arrays([*kept, batch.column("__raw"), *found], names=[*own, "__raw", "__spans", "__items"])

    made = f"array<struct<start:long,stop:long>>, {'items' if last else '__items'} array<{kind}>"
    return rows.mapInArrow(run, f"{fields}, n_words long, n_hit long, spans {made}" if last else f"{fields}, __raw binary, __spans {made}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``annotate``'s."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
