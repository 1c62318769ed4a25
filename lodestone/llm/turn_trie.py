"""The trie of conversations' beginnings, by double arrays over shards of sorted sequences.

A conversation is a sequence of turns, a node of the trie a beginning that conversations share. Sequences of turn digests are sorted and
range-partitioned by their content, so each shard is a run of neighbours: a prefix however common is cut into as many shards as it
needs, equal sequences included, and only the beginnings of a shard's first and last sequence can lie in other shards too. A shard numbers its
turns densely, packs its trie into the arrays BASE and CHECK (a child's slot is BASE of its parent plus the turn's number, and CHECK there names the
parent), walks every sequence through them, and settles all its inner nodes by itself. What lies on the first and the last
path is sent as partial sums and merged by key: members and sizes by one aggregation, sums over subtrees by giving each shared node to one
path, summing each path from its end, and adding up the paths that pass a node.

A sequence is held in segments of SEGMENT turns. A deeper segment that several conversations share is a shard's work under its own root, deepest
first, and its sums are carried to the segment above; what one conversation has for itself is a chain that needs no trie. So
neither a long conversation nor a common beginning is ever one task's.

Defined results: rows without conv_id are left out; the order within a conversation is turn (nulls first), then role, then a digest of role and
text; null roles and texts are empty; repeated rows are turns like any other; turns are the same if their MD5 is. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import materialize, ship_package

SEGMENT = 1024  # turns
SHARD = 60_000  # turns that one pair of arrays takes
TRIES = 100  # places that are tried for a node's children before they go to the end, as long as the arrays are not too thin
FAMILY, HEADS = 5, 9  # of the rebuilding: conversations that share a beginning, and one more than its most turns
_ROOT = ""
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SENT = "kind int, path long, key string, parent_key string, size long, " + _NODE
_EMPTY = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """BASE and CHECK over dense codes. Slot 0 is the root; a free slot's CHECK is -1.

    ``codes``: all sequences one after the other; ``offsets``: where each begins. Sequences with a common beginning are neighbours, the shorter first.
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        self.base, self.check, self._low, self._used = [0], [0], 1, 1
        self._thin = 8 * (len(codes) + 16)
        self._fill(codes.tolist(), offsets.tolist())
        self.base, self.check = np.array(self.base, np.int64), np.array(self.check, np.int64)

    def _free(self, slot: int) -> int:
        check = self.check
        while slot < len(check) and check[slot] >= 0:
            slot += 1
        return slot

    def _place(self, parent: int, codes: list[int]) -> int:
        """Finds room for the children ``codes`` (ascending), takes it, and gives BASE."""
        first, span = codes[0], codes[-1] - codes[0] + 1
        slot, tries = self._free(self._low), 0
        self._low = slot
        while True:
            missing = slot + span - len(self.check)
            if missing > 0:
                self.check += [-1] * missing
                self.base += [0] * missing
            if all(self.check[slot + c - first] < 0 for c in codes):
                break
            tries += 1
            slot = len(self.check) if tries >= TRIES and len(self.check) < self._thin else self._free(slot + 1)
        for c in codes:
            self.check[slot + c - first] = parent
        self._used += len(codes)
        self.base[parent] = slot - first
        return slot - first

    def _fill(self, codes: list[int], offsets: list[int]) -> None:
        waiting = [(0, 0, len(offsets) - 1, 0)]
        while waiting:
            slot, low, high, depth = waiting.pop()
            while low < high and offsets[low + 1] - offsets[low] == depth:
                low += 1
            runs = []
            for k in range(low, high):
                code = codes[offsets[k] + depth]
                if not runs or runs[-1][0] != code:
                    runs.append([code, k, k + 1])
                else:
                    runs[-1][2] = k + 1
            if runs:
                base = self._place(slot, sorted(r[0] for r in runs))
                waiting += [(base + code, a, b, depth + 1) for code, a, b in runs]

    def step(self, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        after = self.base[slots] + codes
        if not (self.check[after] == slots).all():
            raise ValueError("a sequence is not in the trie")
        return after


def _key(above: str, digest: bytes) -> str:
    return hashlib.md5(above.encode() + digest).hexdigest()


class Shard:
    """One run of sorted sequences under one root, as rows of ``_SENT``: kind 0 settled nodes, 1 partial sums of the first and last path, 2 conversations
    that end on these paths."""

    def __init__(self, root: str, above: int):
        self.root, self.above = root, above  # above: the root's depth
        self.convs: list[int] = []
        self.digests: list[bytes] = []
        self.sizes: list[list[int]] = []
        self.ends: list[bool] = []
        self.carried: list[tuple[int, int, int]] = []
        self.turns = 0

    def add(self, conv: int, digests: bytes, sizes: list[int], ends: bool, carried: tuple[int, int, int]) -> None:
        self.convs.append(conv)
        self.digests.append(digests)
        self.sizes.append(sizes)
        self.ends.append(ends)
        self.carried.append(carried)
        self.turns += len(sizes) + 1

    def rows(self, number: int) -> Iterator[tuple]:
        convs = np.array(self.convs, np.int64)
        lengths = np.array([len(x) for x in self.sizes], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        turn = np.frombuffer(b"".join(self.digests), "V16")
        owner = np.repeat(np.arange(len(convs)), lengths)
        depths = np.arange(len(turn)) - offsets[owner]
        order = np.lexsort((owner, depths))  # by depth: children of a node are numbered side by side where they are seen first
        _, first, code = np.unique(turn[order].view("S16"), return_index=True, return_inverse=True) if len(turn) else (None, np.zeros(0, int), np.zeros(0, int))
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        codes = np.empty(len(turn), np.int64)
        codes[order] = rank[code]
        trie = DoubleArray(codes, offsets)

        n_slots = len(trie.check)
        members, smallest = np.zeros(n_slots, np.int64), np.full(n_slots, np.iinfo(np.int64).max)
        size, depth = np.zeros(n_slots, np.int64), np.full(n_slots, -1, np.int64)
        all_sizes = np.fromiter((s for x in self.sizes for s in x), np.int64, len(turn))
        at, layers = np.zeros(len(convs), np.int64), [np.zeros(1, np.int64)]
        members[0], smallest[0], depth[0] = len(convs), convs.min(), 0
        bounds = np.concatenate(([0], np.cumsum(np.bincount(depths)))) if len(turn) else [0]
        paths = [[0], [0]]
        for d in range(len(bounds) - 1):
            where = order[bounds[d] : bounds[d + 1]]
            who = owner[where]
            slots = trie.step(at[who], codes[where])
            at[who] = slots
            members += np.bincount(slots, minlength=n_slots)
            np.minimum.at(smallest, slots, convs[who])
            size[slots], depth[slots] = all_sizes[where], d + 1
            layers.append(np.unique(slots))
            for path, k in zip(paths, (0, len(convs) - 1), strict=True):
                if lengths[k] > d:
                    path.append(int(at[k]))

        shared = np.zeros(n_slots, bool)
        shared[paths[0] + paths[1]] = True
        used = np.flatnonzero(depth > 0)
        carried = np.array(self.carried, np.int64)
        children, leaves, saved = (np.zeros(n_slots, np.int64) for _ in range(3))
        for total, k in ((children, 0), (leaves, 1), (saved, 2)):
            np.add.at(total, at, carried[:, k])
        np.add.at(children, trie.check[used[~shared[used]]], 1)  # children on the paths are counted when all shards are known
        for layer in reversed(layers[1:]):
            own = layer[~shared[layer]]
            leaves[own] += children[own] == 0
            saved[own] += (members[own] - 1) * size[own]
            np.add.at(leaves, trie.check[own], leaves[own])
            np.add.at(saved, trie.check[own], saved[own])

        ended: dict[int, list[int]] = {}
        for k in np.lexsort((convs, at)).tolist():
            if self.ends[k]:
                ended.setdefault(int(at[k]), []).append(self.convs[k])
        keys = {0: self.root}
        turn_of = {}
        for path, k in zip(paths, (0, len(convs) - 1), strict=True):
            for d, slot in enumerate(path[1:]):
                if slot not in keys:
                    keys[slot] = _key(keys[path[d]], self.digests[k][16 * d : 16 * d + 16])
                    turn_of[slot] = path[d]
        for slot in used[~shared[used]].tolist():
            parent = int(trie.check[slot])
            known = None if parent in keys else int(smallest[parent])
            ends = hashlib.sha256(",".join(map(str, ended[slot])).encode()).hexdigest() if slot in ended else _EMPTY
            yield 0, None, None, keys.get(parent), int(size[slot]), int(smallest[slot]), self.above + int(depth[slot]), known, int(members[slot]), int(children[slot]), int(leaves[slot]), int(saved[slot]), ends
        seen = set()
        for side, path in enumerate(paths):
            for slot in path:
                new = slot not in seen  # the last path repeats the nodes above, without their sums, so that it is whole
                seen.add(slot)
                above = keys[turn_of[slot]] if slot else None
                sums = (int(smallest[slot]), int(members[slot]), int(children[slot]), int(leaves[slot]), int(saved[slot])) if new else (None, 0, 0, 0, 0)
                yield 1, 2 * number + side, keys[slot], above, int(size[slot]), sums[0], self.above + int(depth[slot]), None, *sums[1:], None
                if new:
                    for conv in ended.get(slot, ()):
                        yield 2, None, keys[slot], None, None, conv, None, None, None, None, None, None, None


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), same (digest), size (of the text), total: every turn's place in its conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    same = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), same.alias("same"), F.octet_length(text).cast("long").alias("size")
    )
    keys = ["conv_id", "turn", "role", "same"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "salt").sortWithinPartitions(*keys)
    ordered = materialize(ordered.select("conv_id", "same", "size", F.monotonically_increasing_id().alias("place")), "turn-order")
    ordered = ordered.withColumn("part", F.shiftright("place", 33))
    stretch = ordered.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("conv_id")  # a row for each partition that holds some of the conversation
    stretch = stretch.select("conv_id", "part", "first", (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("total"))
    return ordered.join(stretch, ["conv_id", "part"]).select("conv_id", (F.col("place") - F.col("first") + F.col("before") + 1).alias("pos"), "same", "size", "total")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the beginning of the first of their family: (conv_id, depth, same, size) of each turn, and (conv_id, length) of each conversation.

    The first h turns are those of conversation c - c % FAMILY (all, if it has fewer; none, if there is no such one), h a checksum of c modulo HEADS;
    then come the conversation's own after its first h.
    """
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "same", "size"))).alias("head"))  # less than HEADS
    convs = turns.where("pos = 1").select("conv_id", "total", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    convs = convs.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce(F.size("head"), F.lit(0))).cast("long"))
    convs = convs.withColumn("taken", F.greatest("taken", F.lit(0)))
    begun = convs.where("taken > 0").select("conv_id", F.posexplode(F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("k", "turn"))
    begun = begun.select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), "turn.same", "turn.size")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "same", "size")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length"))
    return begun.unionByName(own), lengths


def _roots(segments: DataFrame) -> DataFrame:
    """(conv_id, j, root) of segments after the first: a digest of all segments before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, _ROOT
        for batch in batches:
            roots = []
            for conv, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                now, key = conv, key if conv == now else _ROOT
                roots.append(key)
                key = _key(key, (digest or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.string())], names=["conv_id", "j", "root"])

    rows = segments.where("length >= top").select("conv_id", "j", F.md5("digests").alias("digest"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "j").mapInArrow(run, "conv_id long, j long, root string")


def _segments(turns: DataFrame, lengths: DataFrame, segment: int) -> DataFrame:
    """conv_id, j, root, digests, sizes, ends: SEGMENT turns in a row, and one without turns behind a conversation that ends on a segment's edge
    (so that a root has all of its members), and for one without turns."""
    j = F.floor((F.col("depth") - 1) / segment).alias("j")
    rows = turns.groupBy("conv_id", j).agg(F.array_sort(F.collect_list(F.struct("depth", "same", "size"))).alias("t"))
    rows = rows.select("conv_id", "j", F.unhex(F.array_join(F.transform("t", lambda x: x.same), "")).alias("digests"), F.transform("t", lambda x: x.size).alias("sizes"))
    edge = lengths.where(F.col("length") % segment == 0)
    edge = edge.select("conv_id", F.floor(F.col("length") / segment).alias("j"), F.lit(b"").alias("digests"), F.array().cast("array<long>").alias("sizes"))
    rows = rows.unionByName(edge).join(lengths, "conv_id").withColumn("top", F.lit(segment))
    rows = rows.withColumn("ends", (F.col("j") == F.floor((F.greatest("length", F.lit(1)) - 1) / segment)))
    rows = materialize(rows, "segments")
    return rows.join(_roots(rows), ["conv_id", "j"], "left").withColumn("root", F.coalesce("root", F.lit(_ROOT))).select("conv_id", "j", "root", "digests", "sizes", "ends", "length")


def _packed(level: DataFrame, above: int) -> DataFrame:
    """The shards' rows of one level of segments: ``_SENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 8, pa.string()]
        names = [x.split()[0] for x in _SENT.split(", ")]
        out = []
        for row in sent(batches):
            out.append(row)
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema, strict=True)], names=names)

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        number, shard = TaskContext.get().partitionId() << 30, None
        for batch in batches:
            for root, conv, digests, sizes, ends, *carried in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is not None and (shard.root != root or shard.turns >= SHARD):
                    yield from shard.rows(number)
                    number, shard = number + 1, None
                if shard is None:
                    shard = Shard(root, above)
                shard.add(conv, digests, sizes, ends, tuple(carried))
        if shard is not None:
            yield from shard.rows(number)

    parts = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["root", "digests", "conv_id"]
    rows = level.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return rows.select("root", "conv_id", "digests", "sizes", "ends", "children", "leaves", "saved").mapInArrow(run, _SENT)


def _digests(ended: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the conversations that end at a shared node: SHA-256 takes them in order, so a node is one task's, which streams them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            keys, found = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if sha is not None:
                        keys.append(now)
                        found.append(sha.hexdigest())
                    now, sha = key, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return ended.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "conv_id").mapInArrow(run, "key string, ends_sha256 string")


def _merged(sent: DataFrame) -> DataFrame:
    """The shared nodes of a level, settled: key and the columns of ``_NODE``."""
    paths = sent.where("kind = 1")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = paths.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.min("path").alias("owner"), *sums)
    nodes = materialize(nodes, "shared-nodes")
    below = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("below"))
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0)))
    own = nodes.select(
        "key", "owner", (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("own_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("own_saved")
    )
    mine = F.col("owner") == F.col("path")
    along = Window.partitionBy("path").orderBy(F.desc("depth"))  # no longer than a segment
    rows = paths.select("path", "depth", "key").join(own, "key")
    rows = rows.select("key", *(F.sum(F.when(mine, F.col(c)).otherwise(0)).over(along).alias(c) for c in ("own_leaves", "own_saved")))
    totals = rows.groupBy("key").agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved_tokens"))
    above = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, "key").join(above, "parent_key", "left").join(_digests(sent.where("kind = 2")), "key", "left")
    out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return materialize(out.select("key", "parent_key", *(x.split()[0] for x in _NODE.split(", "))), "shared-totals")


def nodes(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, depth (from 1 without gaps), same, size; ``lengths``: conv_id, length, once for each conversation.
    """
    spark = turns.sparkSession
    ship_package(spark)
    columns = [x.split()[0] for x in _NODE.split(", ")]
    segments = materialize(_segments(turns, lengths, segment), "rooted")
    counts = segments.where("j > 0").groupBy("j", "root").agg(F.count("*").alias("sharers"))
    segments = segments.join(counts, ["j", "root"], "left").withColumn("sharers", F.when(F.col("j") == 0, 2).otherwise(F.col("sharers")))
    alone = segments.where("sharers = 1 and size(sizes) > 0")
    deepest = segments.where("sharers > 1").agg(F.max("j")).first()[0]  # a number
    if deepest is None:
        return spark.createDataFrame([], _NODE)
    chain = alone.select("conv_id", "length", F.posexplode("sizes").alias("k", "size"), (F.col("j") * segment + 1 + F.col("k")).alias("depth"))
    last = F.col("depth") == F.col("length")
    out = chain.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(_EMPTY).alias("ends_sha256"),
    )
    carry = None
    for j in range(deepest, -1, -1):
        chained = alone.where(F.col("j") == j + 1).select("conv_id", F.lit(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        carry = chained if carry is None else carry.unionByName(chained)
        level = segments.where((F.col("j") == j) & (F.col("sharers") > 1)).join(carry, "conv_id", "left").na.fill(0, ["children", "leaves", "saved"])
        if j:
            level = level.withColumn("ends", F.col("ends") & (F.size("sizes") > 0))
        sent = materialize(_packed(level, j * segment), "shards")
        merged = _merged(sent)
        above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
        settled = sent.where("kind = 0").join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
        shared = merged.where("parent_key is not null") if j else merged
        out = out.unionByName(settled.select(*columns)).unionByName(shared.select(*columns))
        carry = merged.where("parent_key is null and n_children > 0").select("conv_id", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    return out
