"""Exact set-similarity join: all pairs of texts whose shingle sets have at least a given Jaccard similarity.

Prefix filter: in one order of all shingles, two sets with Jaccard t or more share one of their first n - ceil(t n) + 1. Only these
are posted. The order puts frequent shingles last; it decides the cost, never the result. How frequent they are is counted over all
texts, but only over what would be posted: first in the order of hashes, then, as the frequent ones found so far leave the
prefixes and others enter them, again. (A bounded sample of whole sets starts the count with the most frequent ones.) A pair comes
from each shared shingle whose predecessors differ (the first shared one is always such), if sizes and positions allow the
overlap; candidates are verified on the whole sets. Shingles are compared by 64 bits of a hash.

Texts are named by an id; rows with equal ids hold equal texts, and count once. The texts stay where they are and are read once for each
count, for the postings and for each verification; postings, ids and the shingles of candidates are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import discard, materialize, settings, ship_package

KNOWN_SHINGLES = 1_000_000  # that every task knows the number of, 16 bytes each; more of them, the least frequent first, count as rare
FREQUENT = 3  # texts, from which on a shingle is counted
SAMPLE_ROWS = 20_000  # whole sets
COUNTS = 2
SLICES = 3
SKETCH_BLOCK, SET_BLOCK = 32 << 20, 8 << 20  # bytes of sketches and of sets in a block; a task holds two blocks
LEAST_BLOCKS, ROUND_BLOCKS = 6, 8
MOST_CELL_TASKS = 1000
PAIR_ROWS = 4000  # of a batch of numbers; a batch of texts ends by its bytes before
PIECE_BYTES, MET_ENTRIES = 512 << 10, 1 << 20
BITMAP_BITS = 26
SEEN_IDS = 100_000  # a task leaves out copies it has met; which it remembers does not matter
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
Cut = Callable[[bytes], np.ndarray]
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]]


def _digests(parts) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p) for p in parts], np.uint64)).view(np.int64)


def word_shingles(width: int) -> Cut:
    """Shingles of ASCII-lower-cased words between white space; fewer than ``width`` words are one shingle."""

    def cut(raw: bytes) -> np.ndarray:
        words = raw.translate(_LOWER).split()
        return _digests(b" ".join(words[k : k + width]) for k in range(max(len(words) - width + 1, 1)))

    return cut


def cut_all(cut: Cut, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes and, one after another, the shingles of the sets of all texts; a cut with ``many`` makes them at once."""
    many = getattr(cut, "many", None)
    if many is not None:
        return many(texts)
    found = [cut(x) for x in texts.to_pylist()]
    return np.array([len(x) for x in found], np.int64), np.concatenate([np.zeros(0, np.int64), *found])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of id and text (binary) without ids met before, in pieces of some PIECE_BYTES."""
    seen: set[int] = set()
    for batch in batches:
        new = [k for k, x in enumerate(batch.column(0).to_pylist()) if not (x in seen or seen.add(x))]
        batch = batch.take(pa.array(new, pa.int64()))
        seen = set() if len(seen) > SEEN_IDS else seen
        piece = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // PIECE_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for at, end in pairwise(bounds):
            if end > at:
                yield batch.slice(at, end - at)


def _lists(sizes: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))


def _bitmap(ids: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which buckets of ``2**bits`` the ids fall in, as 64-bit words: at most 2**bits / 8 bytes whatever the number of ids."""
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    words = ids.select(F.shiftrightunsigned(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def _sets(texts: DataFrame, cut: Cut, wanted: DataFrame | None = None, bits: int = BITMAP_BITS, made: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """id, grams (or what is ``made`` of them); with ``wanted`` (id), of these and some others: those that a bitmap of bounded size cannot tell from them."""
    sent = None if wanted is None else texts.sparkSession.sparkContext.broadcast(_bitmap(wanted, bits))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent is not None:
                slot = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((sent.value[slot >> 6] >> (slot & 63)) & 1 == 1))
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(asked(batches)):
            sizes, grams = cut_all(cut, part.column(1))
            if made is not None:
                own = [made(x) for x in np.split(grams, np.cumsum(sizes)[:-1])]
                sizes, grams = np.array([len(x) for x in own], np.int64), np.concatenate(own)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sizes, grams)], names=["id", "grams"])

    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    return texts.select("id", F.col("text").cast("binary").alias("text"), slot.alias("slot")).mapInArrow(run, "id long, grams array<long>")


Known = tuple[np.ndarray, np.ndarray]


def _prefixes(texts: DataFrame, cut: Cut, least: float, known: Known, columns: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Of gram, id, prev, size, at the ``columns`` of each set's prefix. ``known``: frequent shingles, sorted, and their counts. ``part`` (k, n): the
    shingles of the k-th of n parts only."""
    sent = texts.sparkSession.sparkContext.broadcast(known)
    names = columns.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_grams, counts = sent.value
        for batch in _pieces(batches):
            sizes, grams = cut_all(cut, batch.column(1))
            row = np.repeat(np.arange(len(sizes)), sizes)
            often = np.zeros(len(grams), np.int64)
            if len(often_grams):
                place = np.minimum(np.searchsorted(often_grams, grams), len(often_grams) - 1)
                often = np.where(often_grams[place] == grams, counts[place], 0)
            bounds = np.concatenate(([0], np.cumsum(sizes))).tolist()
            own = grams[np.concatenate([x + np.argsort(often[x:y], kind="stable") for x, y in pairwise(bounds)])]  # a set's shingles are sorted
            at = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prev = np.where(at == 0, 0, np.concatenate((own[:1], own[:-1])))
            prefix = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
            kept = np.flatnonzero((at < prefix[row]) & (own.view(np.uint64) % part[1] == part[0]))
            out = {"gram": own, "id": batch.column(0).to_numpy()[row], "prev": prev, "size": sizes[row], "at": at}
            yield pa.RecordBatch.from_arrays([pa.array(out[c][kept]) for c in names], names=names)

    return texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1


def _added(known: Known, counted: DataFrame) -> Known:
    """``known`` and the most frequent of ``counted`` (gram, n), as far as ``KNOWN_SHINGLES`` goes: whole steps of an eighth of an octave."""
    counted = materialize(counted.select("gram", "n", F.floor(F.log2("n") * 8).cast("int").alias("step")), "frequent")
    room, lowest = KNOWN_SHINGLES - len(known[0]), None
    for step, n in counted.groupBy("step").count().orderBy(F.desc("step")).collect():  # a few hundred at most
        if n > room:
            break
        room, lowest = room - n, step
    if lowest is not None:
        found = counted.where(F.col("step") >= lowest).select("gram", "n").toArrow()
        grams, counts = np.concatenate((known[0], found.column(0).to_numpy())), np.concatenate((known[1], found.column(1).to_numpy()))
        order = np.lexsort((-counts, grams))
        grams, counts = grams[order], counts[order]
        first = np.concatenate(([True], grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, bool)
        known = grams[first], counts[first]
    discard(counted)
    return known


def _frequent(texts: DataFrame, cut: Cut, least: float) -> Known:
    """Shingles (sorted) that several unequal texts have, and how often, the most frequent ones."""
    share = max(1, texts.count() // SAMPLE_ROWS)
    drawn = _sets(texts.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0), cut).select("id", F.explode("grams").alias("gram"))
    posted = lambda known: _prefixes(texts, cut, least, known, "gram, id")
    known: Known = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for k in range(COUNTS + 1):
        if len(known[0]) > 0.9 * KNOWN_SHINGLES:
            break  # there is hardly room for what a count would find
        counted = (posted(known) if k else drawn).groupBy("gram").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("z"))
        known = _added(known, counted.where((F.col("a") != F.col("z")) & (F.col("n") > (FREQUENT if k else 1))).select("gram", (F.col("n") * (1 if k else share)).alias("n")))
    return known


def _shared(batches: Iterator[pa.RecordBatch], beside_hub: bool = True) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by shingle and id, those whose shingle another id has, beside the first posting of the shingle if asked."""
    names = ["gram", "id", "prev", "size", "at"]
    lone: list[np.ndarray] = [np.zeros(0, np.int64)] * 5  # the latest posting, while it is its shingle's only one
    last, hub = None, None  # the latest shingle and id, and the first posting of a shingle that goes on
    for batch in batches:
        own = [np.concatenate((x, c.to_numpy())) for x, c in zip(lone, batch.columns, strict=True)]
        same = (own[0][1:] == own[0][:-1]) & (own[1][1:] == own[1][:-1])
        again = np.concatenate(([not len(lone[0]) and len(own[0]) > 0 and last == (own[0][0], own[1][0])], same)) if len(own[0]) else np.zeros(0, bool)
        own = [x[~again] for x in own]
        gram = own[0]
        if not len(gram):
            continue
        starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        sizes = np.diff(np.append(starts, len(gram)))
        hubs = [np.repeat(x[starts], sizes) for x in own[1:]] if beside_hub else []
        keep = np.repeat(sizes > 1, sizes)
        goes_on = hub is not None and last[0] == gram[0]
        if goes_on:
            keep[: sizes[0]] = True
            for x, value in zip(hubs, hub, strict=False):
                x[: sizes[0]] = value
        alone = sizes[-1] == 1 and not (goes_on and len(sizes) == 1)
        last = gram[-1], own[1][-1]
        lone = [x[-1:] if alone else x[:0] for x in own]
        hub = None if alone else [x[-1] for x in hubs]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*own, *hubs)], names=[*names, *(f"hub_{n}" for n in names[1:])][: len(own) + len(hubs)])


def postings(texts: DataFrame, cut: Cut, least: float) -> DataFrame:
    """gram, id, prev, size, at: the prefix of each set, as far as another set's prefix shares the shingle, beside the shingle's posting of
    the smallest id (hub_id, hub_prev, hub_size, hub_at)."""
    ship_package(texts.sparkSession)
    return _posted(texts, cut, least, _frequent(texts, cut, least))


def _posted(texts: DataFrame, cut: Cut, least: float, known: Known, part: tuple[int, int] = (0, 1), beside_hub: bool = True) -> DataFrame:
    names = "gram, id, prev, size, at"
    rows = _prefixes(texts, cut, least, known, names, part)
    schema = ", ".join(f"{c} long" for c in (names + ", hub_id, hub_prev, hub_size, hub_at" * beside_hub).split(", "))
    found = rows.repartition("gram").sortWithinPartitions("gram", "id").mapInArrow(partial(_shared, beside_hub=beside_hub), schema)
    return materialize(found, "postings")


def _likely(least: float, a: list[Column], b: list[Column]) -> Column:
    """Whether sizes and positions of two postings (prev, size, at) of one shingle allow Jaccard ``least``."""
    need = least / (1 + least) * (a[1] + b[1]) - 1e-6
    rest = F.least(a[1] - a[2], b[1] - b[2]) >= need
    return rest & (F.least(a[1], b[1]) >= least * F.greatest(a[1], b[1]) - 1e-6)


def _allowed(least: float, a: list[Column], b: list[Column]) -> Column:
    """Whether they do and the predecessors differ, so that a pair comes once for a run of shared shingles."""
    return ((a[2] == 0) | (b[2] == 0) | (a[0] != b[0])) & _likely(least, a, b)


def _of(alias: str, prefix: str = "") -> list[Column]:
    return [F.col(f"{alias}.{prefix}{c}") for c in ("prev", "size", "at")]


def candidates(posted: DataFrame, least: float) -> DataFrame:
    """left_id, right_id: all pairs that the postings allow."""
    a, b = posted.alias("a"), posted.alias("b")
    both = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")) & _allowed(least, _of("a"), _of("b"))
    return a.join(b, both).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()


def candidates_across(posted: DataFrame, labels: DataFrame, least: float, stars: DataFrame | None = None) -> DataFrame:
    """left_id, right_id: the pairs that the postings allow between ids of unequal labels. ``labels``: node, component; other ids stand for
    themselves. Pairs of one label are never formed: a shingle's labels meet first, then the postings of two labels, those of the one with fewer
    first. Sizes are dealt into classes a factor of 1 / ``least`` wide, so that only equal or neighbouring classes can hold a pair.

    With ``stars`` (id, star) pairs of one star are left out, too (``star_candidates`` has them)."""
    named = posted.select("gram", "id", "prev", "size", "at").join(labels, posted.id == labels.node, "left").withColumn("label", F.coalesce("component", "id"))
    if stars is None:
        named = named.withColumn("star", F.col("id"))
    else:
        named = named.join(stars.select("id", "star"), "id", "left").withColumn("star", F.coalesce("star", "id"))
    step = F.floor(F.log(F.col("size")) / math.log(1 / least) + 1e-9).cast("int")
    named = named.select("gram", "label", F.when(F.lit(stars is None), F.lit(0).cast("long")).otherwise(F.col("star")).alias("star"), "id", "prev", "size", "at", step.alias("step"))
    several = named.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("star").alias("v"), F.max("star").alias("w"))
    several = several.where("x <> y" if stars is None else "x <> y and v <> w").select("gram")
    mixed = materialize(named.join(several, "gram", "left_semi"), "mixed-postings")
    own = mixed.groupBy("gram", "label", "star", "step").agg(F.count("*").alias("n"), F.max(F.col("size") - F.col("at")).alias("rest"), F.min("size").alias("size"))
    near = own.select("gram", F.struct("n", "label", "star", "step", "rest", "size").alias("b"), F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)])).alias("step"))
    fits = F.least("a.rest", "b.rest") >= least / (1 + least) * (F.col("a.size") + F.col("b.size")) - 1e-6  # for some posting of either
    apart = (F.col("a.label") != F.col("b.label")) & (F.col("a") < F.col("b")) & fits
    if stars is not None:
        apart = apart & (F.col("a.star") != F.col("b.star"))
    met = own.select("gram", "step", F.struct("n", "label", "star", "step", "rest", "size").alias("a")).join(near, ["gram", "step"]).where(apart).select("gram", "a", "b").alias("m")
    same = lambda cell, rows: (F.col(f"{cell}.label") == F.col(f"{rows}.label")) & (F.col(f"{cell}.star") == F.col(f"{rows}.star")) & (F.col(f"{cell}.step") == F.col(f"{rows}.step"))
    left = met.join(mixed.alias("p"), (F.col("m.gram") == F.col("p.gram")) & same("m.a", "p"))
    left = left.select("m.gram", F.col("m.b").alias("cell"), F.col("p.id").alias("a_id"), *[F.col(f"p.{c}").alias(f"a_{c}") for c in ("prev", "size", "at")]).alias("l")
    pairs = left.join(mixed.alias("q"), (F.col("l.gram") == F.col("q.gram")) & same("l.cell", "q") & _allowed(least, _of("l", "a_"), _of("q")))
    return pairs.select(F.least("l.a_id", "q.id").alias("left_id"), F.greatest("l.a_id", "q.id").alias("right_id")).distinct()


def star_deltas(stars: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """id, star, grams (in which the id's set and that of its star differ), w, room: of ids (id, hub) that share most with their hub.

    For two ids of a star to have Jaccard ``least``, their differences must share w + w' - room shingles at least; so an id is similar to the hub itself if
    its w is no more than ``room``.
    """
    c = least / (1 + least)
    own, hub = sets.select("id", F.col("grams").alias("a")), sets.select(F.col("id").alias("hub"), F.col("grams").alias("h"))
    both = stars.join(own, "id").join(hub, "hub")
    both = both.select("id", F.col("hub").alias("star"), F.array_except("h", "a").alias("missing"), F.array_except("a", "h").alias("more"), F.size("h").alias("n"))
    w = (1 - c) * F.size("missing") + c * F.size("more")
    return both.where(F.size("missing") + F.size("more") <= F.col("n")).select("id", "star", F.concat("missing", "more").alias("grams"), w.alias("w"), ((1 - 2 * c) * F.col("n")).alias("room"))


def star_candidates(deltas: DataFrame, labels: DataFrame) -> DataFrame:
    """left_id, right_id: pairs of one star and unequal labels whose differences may share enough shingles.

    Two ids that are both similar to the hub have one label already, so one of a pair is not. That says how many shingles its
    differences must share at least, and a prefix filter on the differences, those that are rare in the star first, finds all such pairs: what the hub alone
    lacks is common to the whole star and comes last.
    """
    named = deltas.join(labels, deltas.id == labels.node, "left").select("star", "id", F.coalesce("component", "id").alias("label"), "grams", F.size("grams").alias("n"), "w", "room")
    alone = F.col("w") > F.col("room") + 1e-9
    stats = named.groupBy("star").agg(F.min("w").alias("least_w"), F.min(F.when(alone, F.col("w"))).alias("least_alone"), F.min("label").alias("x"), F.max("label").alias("z"))
    open_ = named.join(stats.where("least_alone is not null and x <> z").drop("x", "z"), "star").withColumn("alone", alone)
    need = F.col("w") - F.col("room") + F.when(F.col("alone"), F.col("least_w")).otherwise(F.col("least_alone"))
    open_ = materialize(open_.withColumn("prefix", F.col("n") - F.greatest(F.ceil(need - 1e-6), F.lit(1)) + 1).where("prefix > 0").drop("least_w", "least_alone"), "star-members")
    each = open_.select("star", "id", F.explode("grams").alias("gram"))
    counts = each.groupBy("star", "gram").agg(F.count("*").alias("often")).where("often > 1")
    # what only one id of a star has meets nothing, but takes its place in the order
    ranked = each.join(counts, ["star", "gram"], "left").groupBy("star", "id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "gram"))).alias("order"))
    posted = ranked.join(open_.drop("grams", "star"), "id").select("star", "id", "label", "n", "w", "room", "alone", F.posexplode(F.slice("order", F.lit(1), F.col("prefix").cast("int"))).alias("at", "o"))
    posted = materialize(posted.where("o.often > 1").select("star", "id", "label", "n", "w", "room", "alone", "at", F.col("o.gram").alias("gram")), "star-postings")
    a, b = posted.alias("a"), posted.alias("b")
    enough = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= F.col("a.w") + F.col("b.w") - F.col("a.room") - 1e-6
    both = (F.col("a.star") == F.col("b.star")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.label") < F.col("b.label")) & (F.col("a.alone") | F.col("b.alone")) & enough
    return a.join(b, both).select(F.least("a.id", "b.id").alias("left_id"), F.greatest("a.id", "b.id").alias("right_id")).distinct()


def _best(met: DataFrame) -> DataFrame:
    """id, hub: of each id's partners (id, hub_id, once for a shared shingle) that which comes most often."""
    return met.groupBy("id", "hub_id").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("hub_id", F.struct("n", -F.col("hub_id"))).alias("hub"))


def as_pairs(hubs: DataFrame) -> DataFrame:
    """left_id, right_id of (id, hub)."""
    return hubs.select(F.least("hub", "id").alias("left_id"), F.greatest("hub", "id").alias("right_id"))


def hubs(posted: DataFrame, least: float) -> DataFrame:
    """id, hub: each id beside that smallest id of a shingle with which it shares most shingles, where both allow the similarity."""
    p = posted.alias("p")
    return _best(p.where((F.col("hub_id") < F.col("id")) & _likely(least, _of("p", "hub_"), _of("p"))).select("id", "hub_id"))


def central(posted: DataFrame, least: float) -> DataFrame:
    """id, hub: each id beside the most central id of a shingle, likewise. The more of its prefix others share, the more central
    an id is: in a family of edited copies that which has the fewest edits of its own."""
    length = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
    share = posted.groupBy("id", "size").agg(F.count("*").alias("n")).select("id", (F.col("n") / length).alias("share"))
    rows = posted.select("gram", "id", "prev", "size", "at").join(share, "id")
    hub = rows.groupBy("gram").agg(F.max_by(F.struct("id", "prev", "size", "at"), F.struct("share", -F.col("id"))).alias("h"))
    met = rows.alias("p").join(hub, "gram").where((F.col("h.id") != F.col("p.id")) & _likely(least, _of("h"), _of("p")))
    return _best(met.select(F.col("p.id").alias("id"), F.col("h.id").alias("hub_id")))


def shingle_sets(pairs: DataFrame, texts: DataFrame, cut: Cut) -> DataFrame:
    """id, grams of the ids in the pairs, in one pass over the texts."""
    named = pairs.select(F.col("left_id").alias("id")).union(pairs.select("right_id")).distinct()
    return materialize(_sets(texts, cut, named).groupBy("id").agg(F.first("grams").alias("grams")), "sets")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose whole shingle sets have Jaccard ``least`` or more."""
    left, right = sets.select(F.col("id").alias("left_id"), F.col("grams").alias("a")), sets.select(F.col("id").alias("right_id"), F.col("grams").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    good = shared * (1 + least) >= least * (F.size("a") + F.size("b")) - 1e-6
    return materialize(pairs.join(left, "left_id").join(right, "right_id").where(good).select("left_id", "right_id"), "pairs")


def verified(pairs: DataFrame, texts: DataFrame, cut: Cut, least: float) -> DataFrame:
    """``similar`` with sets made for these pairs."""
    pairs = materialize(pairs, "candidates")
    sets = shingle_sets(pairs, texts, cut)
    out = similar(pairs, sets, least)
    discard(pairs)
    discard(sets)
    return out


def similar_pairs(texts: DataFrame, cut: Cut, least: float, lists: Cut | None = None, more: Callable[[DataFrame], DataFrame] | None = None, score: Callable[[pa.ListArray], Step] | None = None) -> DataFrame:
    """left_id, right_id: all pairs with Jaccard ``least`` or more, also where candidates are many times the pairs.

    Postings are made and joined in SLICES parts of the shingles. A parity sketch then tells most candidates from similar pairs, and the whole sets settle the rest; either goes to the cells
    of its pairs (``beside``), so that disk follows the texts and the ids of pairs, not candidates times sets.

    ``lists`` cuts a text into the size of its set, the set and what else is to go beside it; ``more`` makes of ids (id) own (array of long), which comes after that. ``score`` makes of
    what lists of a cell hold after the sets that which tells for positions of similar pairs which of them stay, and the similarity of these; it may name the pairs anew.
    """
    spark = texts.sparkSession
    ship_package(spark)
    found = []
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PAIR_ROWS)}):
        known = _frequent(texts, cut, least)
        for k in range(SLICES):
            posted = _posted(texts, cut, least, known, (k, SLICES), beside_hub=False)
            found.append(materialize(candidates(posted, least), "candidates"))
            discard(posted)
        pairs = materialize(reduce(DataFrame.union, found).distinct(), "candidates")
        for x in found:
            discard(x)
        sketches = materialize(_sets(texts, cut, _ends(pairs), made=_sketch).groupBy("id").agg(F.first("grams").alias("v")), "sketches")
        near = beside(pairs, sketches, _likely_step(least), "sketched-pairs", block=SKETCH_BLOCK, close=False)
        discard(pairs)
        discard(sketches)
        named = materialize(_ends(near), "named")
        sets = _sets(texts, lists or _sized(cut), named).groupBy("id").agg(F.first("grams").alias("v")).join(named, "id")
        if more is not None:
            sets = sets.join(more(named), "id").select("id", F.concat("v", "own").alias("v"))
        sets = materialize(sets, "sets")
        out = beside(near, sets, _similar_step(least, score), "pairs", block=SET_BLOCK, close=True, columns="left_id long, right_id long" + ("" if score is None else ", similarity double"))
        for x in (near, named, sets):
            discard(x)
    return out


def _sized(cut: Cut) -> Cut:
    def run(raw: bytes) -> np.ndarray:
        grams = cut(raw)
        return np.concatenate(([len(grams)], grams))

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("left_id").alias("id")).union(pairs.select("right_id")).distinct()


def _likely_step(least: float) -> Callable[[pa.ListArray], Step]:
    allow = _sketches_allow(least)

    def prepare(held: pa.ListArray) -> Step:
        sizes = np.diff(held.offsets.to_numpy())

        def step(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            size, kept = np.cumsum(sizes[left] + sizes[right]) // MET_ENTRIES, []
            for a, z in pairwise([0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(left)]):
                at = pa.array(np.arange(a, z))
                rows = [at, at, held.take(pa.array(left[a:z])), held.take(pa.array(right[a:z]))]
                kept += [x.column(0).to_numpy() for x in allow(iter([pa.RecordBatch.from_arrays(rows, names=["left_id", "right_id", "a", "b"])]))]
            return np.concatenate(kept), {}

        return step

    return prepare


def meetings(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Of pairs in the order of ``right``, for each: it, the pairs' bounds, the entries of all its partners (lists of ``sizes`` one after another), and where each partner's begin."""
    starts = np.cumsum(sizes) - sizes
    step = np.cumsum(sizes[left]) // MET_ENTRIES
    bounds = np.concatenate(([0], np.flatnonzero((right[1:] != right[:-1]) | (step[1:] != step[:-1])) + 1, [len(right)]))
    for a, z in pairwise(bounds.tolist()):
        n = sizes[left[a:z]]
        first = np.cumsum(n) - n
        yield int(right[a]), a, z, np.repeat(starts[left[a:z]] - first, n) + np.arange(n.sum()), first


def _similar_step(least: float, score: Callable[[pa.ListArray], Step] | None) -> Callable[[pa.ListArray], Step]:
    """Lists begin with the size of a set and the set; what comes after is for ``score``."""

    def prepare(held: pa.ListArray) -> Step:
        flat, offsets = held.values.to_numpy(), held.offsets.to_numpy().astype(np.int64)
        sizes = flat[offsets[:-1]]
        of = np.repeat(np.arange(len(sizes)), sizes)
        entries = offsets[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found, code = np.unique(flat[entries], return_inverse=True)
        mark, starts = np.zeros(len(found), np.int64), np.cumsum(sizes) - sizes
        rest = np.diff(offsets) - 1 - sizes
        at = np.repeat(offsets[:-1] + 1 + sizes - (np.cumsum(rest) - rest), rest) + np.arange(rest.sum())
        more = None if score is None else score(_lists(rest, flat[at]))

        def step(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            shared = np.zeros(len(left), np.int64)
            for x, a, z, entry, first in meetings(left, right, sizes):
                own = code[starts[x] : starts[x] + sizes[x]]
                mark[own] = 1
                shared[a:z] = np.add.reduceat(mark[code[entry]], first)
                mark[own] = 0
            kept = np.flatnonzero(shared * (1 + least) >= least * (sizes[left] + sizes[right]) - 1e-6)
            if more is None or not len(kept):
                return kept, {} if more is None else {"similarity": np.zeros(0)}
            which, columns = more(left[kept], right[kept])
            return kept[which], columns

        return step

    return prepare


def _sketch(grams: np.ndarray) -> np.ndarray:
    """The size of a set and, for each of 4 to 8 slots a shingle, whether an odd number falls there: two sets differ in as many shingles at least as slots."""
    slots = 64
    while slots < 4 * len(grams):
        slots *= 2
    odd = np.bincount((grams.view(np.uint64) % slots).astype(np.int64), minlength=slots) & 1
    return np.concatenate(([len(grams)], np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)))


def _sketches_allow(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of left_id, right_id, a, b (sketches) the pairs that can have Jaccard ``least``. The longer sketch is folded to the shorter one's slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [batch.column(c).values.to_numpy().view(np.uint64) for c in (2, 3)]
            starts = [batch.column(c).offsets.to_numpy() for c in (2, 3)]
            lengths = np.stack([np.diff(x) - 1 for x in starts])
            differ = np.zeros(batch.num_rows, np.int64)
            for x, y in np.unique(lengths, axis=1).T if batch.num_rows else ():
                rows = np.flatnonzero((lengths[0] == x) & (lengths[1] == y))
                a, b = (np.bitwise_xor.reduce(f[at[rows][:, None] + 1 + np.arange(n)].reshape(len(rows), -1, min(x, y)), axis=1) for f, at, n in zip(flat, starts, (x, y), strict=True))
                differ[rows] = np.bitwise_count(a ^ b).sum(axis=1)
            sizes = sum(f[at[:-1]].astype(np.int64) for f, at in zip(flat, starts, strict=True))
            yield batch.filter(pa.array(differ * (1 + least) <= (1 - least) * sizes + 1e-6)).select([0, 1])

    return run


def _in_cells(prepare: Callable[[pa.ListArray], Step], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in the order of cells, the values of a cell (left_id, v) before its pairs (left_id, right_id): the pairs that its step keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, step, order, ids = None, [], None, None, None
        for batch in batches:
            cells, pair = batch.column(0).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero((cells[1:] != cells[:-1]) | (pair[1:] != pair[:-1])) + 1
            for a, z in pairwise([0, *bounds.tolist(), len(cells)] if len(cells) else [0]):
                part = batch.slice(a, z - a)
                if cells[a] != cell:
                    cell, held, step = cells[a], [], None
                if not pair[a]:
                    held.append(part.select([1, 3]))
                    continue
                if step is None:
                    ids = np.concatenate([x.column(0).to_numpy() for x in held])
                    step, order = prepare(pa.concat_arrays([x.column(1) for x in held])), np.argsort(ids)
                    ids, held = ids[order], []
                left, right = (order[np.searchsorted(ids, part.column(c).to_numpy())] for c in (1, 2))
                kept, columns = step(left, right)
                columns = {c: part.column(k).to_numpy()[kept] for k, c in ((1, "left_id"), (2, "right_id"))} | columns
                yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names=names)

    return run


def beside(pairs: DataFrame, values: DataFrame, prepare: Callable[[pa.ListArray], Step], name: str, *, block: int, close: bool, columns: str = "left_id long, right_id long") -> DataFrame:
    """left_id, right_id of the pairs that a step keeps, which ``prepare`` makes of the ``values`` (id, v) of a cell; or ``columns``, which the step returns.

    Ids are dealt into blocks of some ``block`` bytes; two blocks are a cell, and a value is sent once to a cell. There the cell's pairs stream past its values,
    so rows of pair and values are never made, and memory is that of two blocks. ``close``: ids with one smallest partner share a block (split where they are many), so that a class meets in few
    cells, and a value goes only to those in which it has a pair; else ids are dealt by hash, and in rounds of ROUND_BLOCKS blocks.
    """
    spark = pairs.sparkSession
    size = 8 * F.size("v") + 16
    n = max(LEAST_BLOCKS, math.ceil((values.agg(F.sum(size)).first()[0] or 0) / block))
    rounds = 1 if close else math.ceil(n / ROUND_BLOCKS)
    slot = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m).cast("long") if isinstance(m, int) else m)
    cell = lambda a, b: F.least(a, b) * (1 << 31) + F.greatest(a, b)
    made = []
    if close:
        partner = pairs.select(F.col("left_id").alias("id"), F.col("right_id").alias("p")).union(pairs.select("right_id", "left_id")).groupBy("id").agg(F.min("p").alias("p"))
        labels = materialize(partner.join(values.select("id", size.alias("bytes")), "id").select("id", "bytes", F.least("id", "p").alias("label")), "labels")
        parts = labels.groupBy("label").agg(F.greatest(F.ceil(F.sum("bytes") / block), F.lit(1)).alias("parts"))
        blocks = materialize(labels.join(parts, "label").select("id", (slot("label", n) + n * slot("id", F.col("parts"))).alias("block")), "blocks")
        ends = [blocks.select(F.col("id").alias(f"{x}_id"), F.col("block").alias(x)) for x in ("left", "right")]
        placed = materialize(pairs.join(ends[0], "left_id").join(ends[1], "right_id").select(cell("left", "right").alias("cell"), "left_id", "right_id"), "placed-pairs")
        wanted = placed.select("cell", F.col("left_id").alias("id")).union(placed.select("cell", "right_id")).distinct()
        sent, made = wanted.join(values, "id").select("cell", "id", "v"), [labels, blocks, placed]
    else:
        placed = pairs.select(cell(slot("left_id", n), slot("right_id", n)).alias("cell"), "left_id", "right_id")
        others = F.explode(F.sequence(*[F.lit(x).cast("long") for x in (0, n - 1)]))
        sent = values.select(slot("id", n).alias("own"), others.alias("other"), "id", "v").select(cell("own", "other").alias("cell"), "id", "v")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n * (n + 1), MOST_CELL_TASKS))
    out = []
    for k in range(rounds):
        own = F.pmod(F.shiftright("cell", 31), F.lit(rounds)) == k if rounds > 1 else F.lit(True)
        rows = sent.where(own).select("cell", F.col("id").alias("left_id"), F.lit(None).cast("long").alias("right_id"), "v")
        rows = rows.union(placed.where(own).select("cell", "left_id", "right_id", F.array().cast("array<long>")))  # Arrow's nulls in lists cost the square of a batch
        met = rows.repartition(width, "cell").sortWithinPartitions("cell", "right_id", "left_id")  # nulls first
        out.append(materialize(met.mapInArrow(_in_cells(prepare, [c.split()[0] for c in columns.split(", ")]), columns), name))
    for x in made:
        discard(x)
    return reduce(DataFrame.union, out)
