"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 4-word shingles, XXH64 (seed 42), a bit is 1 if set in over half the hashes.

Links (at most ``limit`` differing bits): the 64 bits are grouped so that correlated bits share a
partition; partition i gets a threshold t_i (-1: not probed) with sum(t_i) = limit - m + 1, so that of
any linked pair at least one partition differs in at most t_i bits. Partitions and thresholds come from
dynamic programming on candidate counts estimated from a bounded sample. Each fingerprint
is indexed under its own signatures and probes all signatures within t_i; candidates are verified on
all 64 bits.

Equal fingerprints are one node. In a bucket, a search from node to unvisited node finds what is
connected without listing pairs. A bucket of more than ``bucket_limit`` rows (members and probes) is never gathered:
its rows are linked through midpoints (two fingerprints within 4 bits share a value within 2 bits
of both), where each midpoint links its members to the smallest - exact and linear.

Defined results: null texts and texts without words have fingerprint zero, linked like any other;
fewer than four words are one shingle; repeated rows share their fingerprint; null doc_ids are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.graph import components
from lodestone.runtime import materialize, ship_package

SHINGLE = 4
SEED = 42
LIMIT = 4
SAMPLE_ROWS = 20_000
BUCKET_LIMIT = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FULL = (1 << 64) - 1


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(text, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    found = [digest(text[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 8192):
        part = np.array(found[at : at + 8192], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(found), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or b"", width) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of the bit positions: each seed takes the free bits that correlate most with it."""
    if len(sample) > 2:
        b = _bits(sample).astype(float)
        b -= b.mean(0)
        norm = np.sqrt((b * b).sum(0))
        norm[norm == 0] = 1
        like = np.abs(b.T @ b) / np.outer(norm, norm)
    else:
        like = np.zeros((64, 64))
    free, out = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        seed = max(free, key=lambda i: (like[i][free].sum(), -i)) if len(sample) > 2 else free[0]
        own = [seed]
        free.remove(seed)
        while len(own) < size:
            best = max(free, key=lambda i: (like[i][own].sum(), -i))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def estimate(sample: np.ndarray, bits: list[int], threshold: int, rows: int) -> float:
    """Expected rows to move and candidates to verify when ``rows`` fingerprints probe within ``threshold``."""
    if threshold < 0:
        return 0.0
    probes = sum(comb(len(bits), k) for k in range(threshold + 1))
    hits = 0.0
    if len(sample) > 1:
        own = _bits(sample)[:, bits]
        step = max(1, len(own) // 512)
        distance = (own[::step, None, :256] != own[None, ::step, :256]).sum(2)
        np.fill_diagonal(distance, 99)
        hits = float((distance <= threshold).mean()) * rows
    random = probes / 2.0 ** len(bits) * rows
    return rows * (probes + max(hits, random))


def plan(sample: np.ndarray, rows: int, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition at the least estimated cost."""
    best: tuple[float, list] | None = None
    for parts in range(2, limit + 2):
        groups = group_bits(sample, parts)
        # cost[s]: least cost so far for thresholds that sum to s, a threshold of -1 leaves the partition out
        total = limit - parts + 1
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            following: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in cost.items():
                for t in range(-1, 3):
                    new = c + estimate(sample, bits, t, rows)
                    if s + t <= total + parts and (s + t not in following or new < following[s + t][0]):
                        following[s + t] = new, [*ts, t]
            cost = following
        if total in cost and (best is None or cost[total][0] < best[0]):
            best = cost[total][0], [(b, t) for b, t in zip(groups, cost[total][1], strict=True) if t >= 0]
    return best[1]


def _masks(bits: list[int], threshold: int) -> np.ndarray:
    out = [0]
    for k in range(1, threshold + 1):
        out += [sum(1 << i for i in some) for some in combinations(bits, k)]
    return np.array(out, np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def connect(values: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked in one bucket: a search that looks at unvisited nodes only."""
    left, edges = np.arange(len(values)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= limit
            if near.any():
                found = left[near]
                edges += [(at, k) for k in found.tolist()]
                queue += found.tolist()
                left = left[~near]
    return edges


def _bucket_edges(batches: Iterator[pa.RecordBatch], limit: int, bucket_limit: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket: edges between the fingerprints of each bucket. Of a bucket with more than ``bucket_limit`` rows, probes
    included, each fingerprint comes out beside itself instead, as the rows come."""
    rest_key, rest_fp, rest_in, large = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), None

    def flush(key, fp, inside):
        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(bounds)
        indexed = np.add.reduceat(inside.astype(np.int64), bounds[:-1]) if len(key) else np.zeros(0)
        a, b = [], []
        for k in np.flatnonzero((sizes > 1) & (indexed > 0)).tolist():
            values = np.unique(fp[bounds[k] : bounds[k + 1]].view(np.uint64))
            if len(values) > 1:
                for i, j in connect(values, limit):
                    a.append(int(values[i]))
                    b.append(int(values[j]))
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], names=["x", "y"])

    def themselves(fp):
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fp)], names=["x", "y"])

    for batch in batches:
        key = np.concatenate((rest_key, batch.column(0).to_numpy()))
        fp = np.concatenate((rest_fp, batch.column(1).to_numpy()))
        inside = np.concatenate((rest_in, batch.column(2).to_numpy(zero_copy_only=False)))
        if not len(key):
            continue
        if large is not None:  # more of the bucket that goes by midpoints
            n = int(np.searchsorted(key, large, "right"))
            yield themselves(fp[:n])
            key, fp, inside = key[n:], fp[n:], inside[n:]
            if not len(key):
                rest_key, rest_fp, rest_in = key, fp, inside
                continue
            large = None
        cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        wide = np.repeat(np.diff(bounds) > bucket_limit, np.diff(bounds))
        if wide.any():
            yield themselves(fp[wide])
            if wide[-1]:
                large = int(key[-1])
            cut = int((~wide[:cut]).sum())
            key, fp, inside = key[~wide], fp[~wide], inside[~wide]
        if cut:
            yield flush(key[:cut], fp[:cut], inside[:cut])
        rest_key, rest_fp, rest_in = key[cut:], fp[cut:], inside[cut:]
    if len(rest_key):
        yield flush(rest_key, rest_fp, rest_in)


def links(nodes: DataFrame, *, limit: int = LIMIT, sample_rows: int = SAMPLE_ROWS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """x, y: pairs of distinct fingerprints within ``limit`` bits that connect all that are linked. ``nodes``: fp long, distinct."""
    rows = nodes.count()
    drawn = nodes.orderBy(F.xxhash64("fp")).limit(sample_rows) if rows > sample_rows else nodes
    sample = np.array([r[0] for r in drawn.select("fp").collect()], np.int64).view(np.uint64)
    parts = [(k, sum(1 << i for i in bits), _masks(bits, t)) for k, (bits, t) in enumerate(plan(sample, rows, limit))]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(at, 2000).to_numpy().view(np.uint64)
                for k, own, masks in parts:
                    key = _mix((fp & np.uint64(own))[:, None] ^ masks[None, :], k * 0x9E3779B97F4A7C15 & _FULL)
                    inside = np.zeros(key.shape, bool)
                    inside[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(fp.view(np.int64), len(masks))), pa.array(inside.reshape(-1))],
                        names=["key", "fp", "inside"],
                    )

    probes = nodes.select("fp").mapInArrow(probe, "key long, fp long, inside boolean")
    found = probes.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _bucket_edges(it, limit, bucket_limit), "x long, y long")
    found = materialize(found.distinct(), "links")
    hot = found.where("x = y").select(F.col("x").alias("fp"))
    found = found.where("x <> y")
    return found.union(midpoint_links(hot, limit)).distinct() if hot.limit(1).count() else found


def midpoint_links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Star edges through shared midpoints: exact for an even ``limit``, and linear in the nodes."""
    if limit % 2:
        raise ValueError("midpoints need an even limit")
    masks = _masks(list(range(64)), limit // 2)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                fp = batch.column(0).slice(at, 100).to_numpy()
                mid = fp.view(np.uint64)[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(mid.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, len(masks)))], names=["mid", "fp"])

    near = nodes.select("fp").mapInArrow(spread, "mid long, fp long")
    hubs = near.groupBy("mid").agg(F.min("fp").alias("hub"), F.max("fp").alias("other")).where("hub <> other")
    return near.join(hubs, "mid").where("fp <> hub").select(F.col("hub").alias("x"), F.col("fp").alias("y")).distinct()


def near_duplicates(docs: DataFrame, *, width: int = SHINGLE, limit: int = LIMIT, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(docs, width=width), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = links(nodes, limit=limit, bucket_limit=bucket_limit)
    left = nodes.select(F.col("fp").alias("x"), F.col("node").alias("a"))
    right = nodes.select(F.col("fp").alias("y"), F.col("node").alias("b"))
    edges = found.join(left, "x").join(right, "y").select("a", "b")
    joined = components(edges)
    named = nodes.join(joined, nodes.node == joined.node, "left").select("fp", F.coalesce("component", nodes.node).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
