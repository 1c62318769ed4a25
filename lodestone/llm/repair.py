"""Repair of conversations whose turns are lost, blank, doubled, cut off or given to the wrong side.

A conversation is sound if it is empty or its roles' initials read ``s?(ua)+``: an automaton of four states. Its cheapest edits (keep,
rerole, delete, insert) are found by Hirschberg's divide and conquer: costs of the four states from the front and from the
back meet in the middle of the turns, the best crossing is taken, and both halves are solved alike, so that memory follows the
number of states and not the turns. Of crossings of equal cost that with the least audit (edits' initials, compared as ASCII) wins: a
vector from the front also carries the order of its states' least audits, which is enough, since no audit of a prefix of the turns is a
prefix of another one.

A conversation may be as long as it likes. Turns are put in order by a range partitioning on conversation and turn, so a long conversation lies
in several partitions; each partition's stretch is cut into blocks of BLOCK turns, of which four vectors (one for each state before it) say
everything. Vectors meet over the blocks of a stretch, then over the stretches of a conversation, and the crossings come back down,
where each block is solved between its two states. Texts are not needed for any of this, one byte a turn is.

Defined results: the order within a conversation is turn (nulls first), then role, then a digest of role and text; null is a
conversation of its own; null roles and texts are errors of the caller's (``damage`` makes them one space); repeated rows are
turns like any other (and faults). Columns other than conv_id, turn, role and text are left out. Role and text are the same if their MD5 is. Strings that are
no UTF-8 get U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import materialize, ship_package

# fixed values: costs of the edits, and the roles' grammar as an automaton (0 nothing read, 1 system, 2 user, 3 assistant)
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
READS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
ENDINGS = {0: "", 1: "II", 2: "I", 3: ""}  # what makes a sound end of each state
FAULTS = ("", "truncated", "duplicate", "blank")

STATES = range(4)
NEVER = 1 << 60
BLOCK = 4096  # turns
MEMO = 100_000
_SPACE = r"\x20\x09-\x0D"
_TRUNCATED, _DELETED = 4, 8  # a turn's kind: place of its initial in "sua", 3 for others; plus 4 if truncated; 8 if it has to go


def _moves() -> list[list[dict[int, tuple[int, str]]]]:
    """For each kind and state, the cheapest edits over one turn to each later state, the least of equal ones."""
    out = []
    for kind in range(_DELETED + 1):
        table: list[dict[int, tuple[int, str]]] = [{} for _ in STATES]
        for before in STATES:
            at, inserts = before, ""
            for _ in STATES:
                cost = INSERT * len(inserts)
                found = [(at, cost + DELETE, inserts + "D")]
                if kind < _DELETED:
                    more = cost + CUT_OFF * (kind >= _TRUNCATED)
                    kept = READS.get((at, "sua?"[kind % _TRUNCATED]))
                    if kept is not None:
                        found.append((kept, more, inserts + "K"))
                    found.append((READS[at, NEXT_ROLE[at][0]], more + REROLE, inserts + "R"))
                for after, cost, audit in found:
                    table[before][after] = min(table[before].get(after, (NEVER, "")), (cost, audit))
                at, inserts = READS[at, NEXT_ROLE[at][0]], inserts + "I"
        out.append(table)
    return out


MOVES = _moves()
#: Costs of the four states and the order of their least audits; both are 0 to 3 where a state can't be reached.
Vector = tuple[tuple[int, ...], tuple[int, ...]]


def start(state: int) -> Vector:
    return tuple(0 if s == state else NEVER for s in STATES), (0, 0, 0, 0)


def _joined(found: list[tuple[int, int, object] | None]) -> Vector:
    """found: for each state its cost, the order of the audit before, and what orders those that share it."""
    order = {key: k for k, key in enumerate(sorted({f[1:] for f in found if f}))}
    return tuple(f[0] if f else NEVER for f in found), tuple(order[f[1:]] if f else 0 for f in found)


class Solver:
    """Vectors over turns, from the front and from the back, and the divide and conquer on them.

    Steps are remembered by the vector less its least cost; there are few of these.
    """

    def __init__(self):
        self._ahead: dict = {}
        self._back: dict = {}
        self._solved: dict = {}

    def _step(self, costs: tuple, ranks: tuple, kind: int) -> tuple[int, tuple, tuple]:
        key = costs, ranks, kind
        known = self._ahead.get(key)
        if known is None:
            found: list = [None] * 4
            for before in STATES:
                if costs[before] < NEVER:
                    for after, (cost, audit) in MOVES[kind][before].items():
                        new = costs[before] + cost, ranks[before], audit
                        if found[after] is None or new < found[after]:
                            found[after] = new
            made, order = _joined(found)
            least = min(made)
            known = least, tuple(c - least if c < NEVER else c for c in made), order
            if len(self._ahead) >= MEMO:
                self._ahead.clear()
            self._ahead[key] = known
        return known

    def ahead(self, vector: Vector, kinds: bytes) -> Vector:
        costs, ranks = vector
        total = min(costs)
        costs = tuple(c - total if c < NEVER else c for c in costs)
        for kind in kinds:
            more, costs, ranks = self._step(costs, ranks, kind)
            total += more
        return tuple(c + total if c < NEVER else c for c in costs), ranks

    def back(self, costs: tuple, kinds: bytes) -> tuple:
        """Costs to get from each state before ``kinds`` to what ``costs`` stands for."""
        total = 0
        for kind in reversed(kinds):
            key = costs, kind
            known = self._back.get(key)
            if known is None:
                made = [min((cost + costs[after] for after, (cost, _) in MOVES[kind][before].items()), default=NEVER) for before in STATES]
                least = min(made)
                known = least, tuple(c - least if c < NEVER else NEVER for c in made)
                if len(self._back) >= MEMO:
                    self._back.clear()
                self._back[key] = known
            more, costs = known
            total += more
        return tuple(c + total if c < NEVER else NEVER for c in costs)

    def solve(self, kinds: bytes, before: int, after: int) -> str:
        """The least audit of the cheapest edits that lead over ``kinds`` from one state to another."""
        if len(kinds) == 1:
            return MOVES[kinds[0]][before][after][1]
        key = kinds, before, after
        known = self._solved.get(key) if len(kinds) <= 32 else None
        if known is None:
            half = len(kinds) // 2
            costs, ranks = self.ahead(start(before), kinds[:half])
            rest = self.back(start(after)[0], kinds[half:])
            middle = min(STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
            known = self.solve(kinds[:half], before, middle) + self.solve(kinds[half:], middle, after)
            if len(kinds) <= 32:
                if len(self._solved) >= MEMO:
                    self._solved.clear()
                self._solved[key] = known
        return known


def composed(first: list[Vector], second: list[Vector]) -> list[Vector]:
    """Four vectors over two stretches from those over each."""
    out = []
    for costs, ranks in first:
        found: list = [None] * 4
        for middle in STATES:
            if costs[middle] < NEVER:
                for after in STATES:
                    if second[middle][0][after] < NEVER:
                        new = costs[middle] + second[middle][0][after], ranks[middle], second[middle][1][after]
                        if found[after] is None or new < found[after]:
                            found[after] = new
        out.append(_joined(found))
    return out


def crossings(stretches: list[list[Vector]], before: int, after: int) -> list[int]:
    """The states after each stretch on the least of the cheapest ways from one state to another."""
    if len(stretches) == 1:
        return [after]
    half = len(stretches) // 2
    costs, ranks = start(before)
    for one in stretches[:half]:
        costs, ranks = composed([(costs, ranks)], one)[0]
    rest = start(after)[0]
    for one in reversed(stretches[half:]):
        rest = tuple(min(min(one[s][0][t] + rest[t] for t in STATES), NEVER) for s in STATES)
    middle = min(STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
    return crossings(stretches[:half], before, middle) + crossings(stretches[half:], middle, after)


def last_state(vector: Vector) -> int:
    """Where the cheapest edits of a whole conversation end, before its ending."""
    return min(STATES, key=lambda s: (vector[0][s] + INSERT * len(ENDINGS[s]), vector[1][s]))


def _packed(vectors: list[Vector]) -> bytes:
    return np.array(vectors, "<i8").tobytes()


def _unpacked(raw: bytes) -> list[Vector]:
    return [(tuple(costs), tuple(ranks)) for costs, ranks in np.frombuffer(raw, "<i8").reshape(4, 2, 4).tolist()]


def damage(conversations: DataFrame) -> DataFrame:
    """The turns with one in five spoilt, by a checksum of conversation and turn: dropped, emptied, stripped of full stops, doubled or given to the
    user. Nulls count as one space."""
    plain = lambda c: F.coalesce(F.make_valid_utf8(F.col(c)), F.lit(" "))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20
    return (
        conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), code.alias("code"))
        .where("code <> 0")
        .withColumn("text", F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("code") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )


def _ordered(turns: DataFrame) -> DataFrame:
    """The turns with their kind and a place that orders all of them; its upper bits are the partition."""
    text, role = F.make_valid_utf8("text"), F.make_valid_utf8("role")
    initial = F.position(F.substring("role", 1, 1), F.lit("sua"))
    kind = F.when(~F.col("text").rlike(f"[^{_SPACE}]"), _DELETED).otherwise(
        F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1) + F.when(F.col("text").rlike(rf"[^.!?{_SPACE}][{_SPACE}]*\z"), _TRUNCATED).otherwise(0)
    )
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("*", kind.cast("int").alias("kind"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("same"))
    keys = ["conv_id", "turn", "role", "same"]
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows may take any order, and go to several partitions
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *keys, "salt").sortWithinPartitions(*keys).drop("salt")
    return materialize(rows.withColumn("place", F.monotonically_increasing_id()), "turns")


def _part() -> F.Column:
    return F.shiftright("place", 33).cast("int").alias("part")


def _stretches(kinds: DataFrame, conv: str) -> DataFrame:
    """Per block of turns (conv_id, part, block) its kinds and vectors; block -1 has those of the partition's whole stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, out = Solver(), []
        for (own, part), rows in _grouped(batches, 2):
            whole, block, waiting = None, 0, bytearray()
            for raw, done in _ended(rows):
                waiting += raw
                while len(waiting) >= BLOCK or (done and waiting):
                    piece = bytes(waiting[:BLOCK])
                    del waiting[:BLOCK]
                    vectors = [solver.ahead(start(s), piece) for s in STATES]
                    whole = vectors if whole is None else composed(whole, vectors)
                    out.append((own, part, block, piece, _packed(vectors)))
                    block += 1
                    if len(out) >= 1000:
                        yield _batch(out, conv)
                        out = []
            out.append((own, part, -1, None, _packed(whole)))
        if out:
            yield _batch(out, conv)

    kept = kinds.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place")
    return kept.select("conv_id", "part", F.col("kind").cast("tinyint").alias("kind")).mapInArrow(run, f"conv_id {conv}, part int, block int, kinds binary, vectors binary")


def _ended(rows: Iterator[list]) -> Iterator[tuple[bytes, bool]]:
    """The kinds, and at last nothing with a mark of the end."""
    for (kinds,) in rows:
        yield bytes(kinds), False
    yield b"", True


def _batch(rows: list[tuple], conv: str) -> pa.RecordBatch:
    own, parts, blocks, kinds, vectors = zip(*rows, strict=True)
    kind_of = pa.string() if conv == "string" else pa.int64()
    columns = [pa.array(own, kind_of), pa.array(parts, pa.int32()), pa.array(blocks, pa.int32()), pa.array(kinds, pa.binary()), pa.array(vectors, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "block", "kinds", "vectors"])


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[list]]]:
    """Runs of rows that agree in the first columns; each gives the lists of its other columns, a batch at a time. A run has to be read before the next is asked for."""
    pieces = _pieces(batches, keys)
    now = next(pieces, None)

    def run(key: tuple) -> Iterator[list]:
        nonlocal now
        while now is not None and now[0] == key:
            yield now[1]
            now = next(pieces, None)

    while now is not None:
        key = now[0]
        rows = run(key)
        yield key, rows
        for _ in rows:
            pass


def _pieces(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    for batch in batches:
        lists = [c.to_pylist() for c in batch.columns]
        names = list(zip(*lists[:keys], strict=True))
        first = 0
        for k in range(1, len(names) + 1):
            if k == len(names) or names[k] != names[first]:
                yield names[first], [x[first:k] for x in lists[keys:]]
                first = k


def _ends(stretches: DataFrame, conv: str) -> DataFrame:
    """Per stretch the states before and after it, and the conversation's ending behind the last one.

    A conversation has at most one stretch in a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _portions(found(batches)):
            own, parts, before, after, endings = zip(*out, strict=True)
            kind_of = pa.string() if conv == "string" else pa.int64()
            columns = [pa.array(own, kind_of), pa.array(parts, pa.int32()), pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(endings, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "before", "after", "ending"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (own,), rows in _grouped(batches, 1):
            parts, vectors = [], []
            for some, raw in rows:
                parts += some
                vectors += map(_unpacked, raw)
            vector = start(0)
            for one in vectors:
                vector = composed([vector], one)[0]
            last = last_state(vector)
            states = crossings(vectors, 0, last)
            for k, part in enumerate(parts):
                yield own, part, states[k - 1] if k else 0, states[k], ENDINGS[last] if k + 1 == len(parts) else ""

    whole = stretches.where("block = -1").select("conv_id", "part", "vectors")
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, f"conv_id {conv}, part int, before int, after int, ending string")


def _portions(rows: Iterable[tuple], size: int = 1000) -> Iterator[list[tuple]]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out


def _audits(stretches: DataFrame, ends: DataFrame, conv: str) -> DataFrame:
    """Per stretch the state before it, its turns' kinds and its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _portions(found(batches), 200):
            own, parts, before, kinds, audits = zip(*out, strict=True)
            kind_of = pa.string() if conv == "string" else pa.int64()
            columns = [pa.array(own, kind_of), pa.array(parts, pa.int32()), pa.array(before, pa.int32()), pa.array(kinds, pa.binary()), pa.array(audits, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "state", "kinds", "audit"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        solver = Solver()
        for (own, part), rows in _grouped(batches, 2):
            kinds, vectors, state, after, ending = [], [], 0, 0, ""
            for blocks, some, raw, befores, afters, endings in rows:
                for k, block in enumerate(blocks):
                    if block < 0:
                        state, after, ending = befores[k], afters[k], endings[k]
                    else:
                        kinds.append(some[k])
                        vectors.append(_unpacked(raw[k]))
            states = [state, *crossings(vectors, state, after)]
            audit = "".join(solver.solve(piece, states[k], states[k + 1]) for k, piece in enumerate(kinds))
            yield own, part, state, b"".join(kinds), audit + ending

    blocks = stretches.where("block >= 0").select("conv_id", "part", "block", "kinds", "vectors", F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("after"), F.lit(None).cast("string").alias("ending"))
    edges = ends.select("conv_id", "part", F.lit(-1).alias("block"), F.lit(None).cast("binary").alias("kinds"), F.lit(None).cast("binary").alias("vectors"), "before", "after", "ending")
    both = blocks.unionByName(edges).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "block")
    return both.mapInArrow(run, f"conv_id {conv}, part int, state int, kinds binary, audit string")


def repair(turns: DataFrame, *, whole: bool = True) -> DataFrame:
    """The edits of every conversation, one row each: conv_id, place, nth (orders the edits of a place), edit (keep K, rerole R, delete D,
    insert I), turn, role, text and fault (blank, duplicate, truncated, or none) of the turn it is made on, new_role.

    ``turns``: conv_id, turn, role, text. Rows come in order, with all of a conversation in one partition, as far as ``whole`` is set (what a
    digest of a conversation asks for; rows stream through); else each partition's stretch of a conversation keeps its own.
    """
    ship_package(turns.sparkSession)
    rows = _ordered(turns)
    conv = rows.schema["conv_id"].dataType.simpleString()
    if conv not in ("bigint", "string"):
        rows = rows.withColumn("conv_id", F.col("conv_id").cast("long"))
        conv = "bigint"
    first = rows.groupBy("conv_id", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    kinds = rows.select("conv_id", "place", _part(), "kind").join(first, "place", "left")
    kind = F.when(F.col("first").isNull(), _DELETED).otherwise(F.col("kind"))
    stretches = materialize(_stretches(kinds.select("conv_id", "place", "part", kind.alias("kind")), conv), "stretches")
    audits = _audits(stretches, _ends(stretches, conv), conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _portions(edits(batches)):
            columns = list(zip(*out, strict=True))
            kinds_of = [pa.string() if conv == "string" else pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names=["conv_id", "place", "nth", "edit", "turn", "role", "text", "fault", "new_role"])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (own, _), lists in _grouped(batches, 2):
            state, kinds, audit, at, seen, place = 0, b"", "", 0, 0, 0
            for places, numbers, roles, texts, own_kinds, states, some, found in lists:
                for k, place in enumerate(places):
                    if place is None:
                        state, kinds, audit = states[k], some[k], found[k]
                        continue
                    nth = 0
                    while audit[at] == "I":
                        yield own, place, nth, "I", None, None, "", "", NEXT_ROLE[state]
                        state, at, nth = READS[state, NEXT_ROLE[state][0]], at + 1, nth + 1
                    edit, kind, role = audit[at], kinds[seen], roles[k]
                    fault = FAULTS[3 if own_kinds[k] == _DELETED else 2 if kind == _DELETED else kind >= _TRUNCATED]
                    new = None if edit == "D" else role if edit == "K" else NEXT_ROLE[state]
                    yield own, place, nth, edit, numbers[k], role, texts[k], fault, new
                    state = state if new is None else READS[state, new[0]]
                    at, seen = at + 1, seen + 1
            for nth, _edit in enumerate(audit[at:]):
                yield own, place, nth + 1, "I", None, None, "", "", NEXT_ROLE[state]
                state = READS[state, NEXT_ROLE[state][0]]

    nothing = {"place": "long", "turn": "long", "role": "string", "text": "string", "kind": "int", "state": "int", "kinds": "binary", "audit": "string"}
    given = rows.select("conv_id", _part(), *(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    notes = audits.select("conv_id", "part", *(F.col(c) if c in audits.columns else F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    both = given.unionByName(notes)
    both = both.repartition("conv_id") if whole else both.repartition("conv_id", "part")
    return both.sortWithinPartitions("conv_id", "part", "place").mapInArrow(
        run, f"conv_id {conv}, place long, nth int, edit string, turn long, role string, text string, fault string, new_role string"
    )


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digest(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``edits``: ``repair``'s rows, in its order. Of a conversation that has none: zeros, the empty audit and the empty text's digest. SHA-256 takes
    its text from front to back, so a conversation is one task's, which streams it; the audit is one string. Gaps are taken modulo 2^64.
    """
    conv = edits.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _portions(found(batches), 200):
            columns = list(zip(*out, strict=True))
            kinds_of = [pa.string() if conv == "string" else pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (own,), lists in _grouped(batches, 1):
            sha, audit, counts = hashlib.sha256(), [], dict.fromkeys((*FAULTS, "illegal", "cost", "lines"), 0)
            least = greatest = before = None
            different = 0
            for _, _, letters, numbers, roles, texts, faults, new_roles in lists:
                audit.append("".join(letters))
                for edit, turn, role, text, fault, new in zip(letters, numbers, roles, texts, faults, new_roles, strict=True):
                    counts["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                    if new is not None:
                        sha.update(f"{chr(10) * (counts['lines'] > 0)}{new}:{text}".encode())
                        counts["lines"] += 1
                        counts["cost"] += CUT_OFF * (fault == "truncated")
                    if edit == "I":
                        continue
                    counts[fault] += 1
                    if before is not None:
                        counts["illegal"] += before + role[:1] not in ("su", "ua", "au")
                    before = role[:1]
                    if turn is not None and turn != greatest:
                        different += 1
                        least, greatest = turn if least is None else least, turn
            gaps = 0 if least is None else (greatest - least + 1 - different + (1 << 63)) % (1 << 64) - (1 << 63)
            yield own, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], counts["cost"], "".join(audit), sha.hexdigest()

    done = edits.select("conv_id", "place", "nth", "edit", "turn", "role", "text", "fault", "new_role").mapInArrow(run, f"conv_id {conv}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").alias("own")).distinct()
    zeros = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _COUNTS]
    empty = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return every.join(done, F.col("own").eqNullSafe(F.col("conv_id")), "left").select(F.col("own").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), empty)
