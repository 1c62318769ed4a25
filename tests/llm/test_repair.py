"""Conversation repair against plain dynamic programming on whole audits, and by trying all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestone.llm import queries, repair

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}


def _moves(state, role, fault):
    """(letter, cost, state after) of the edits of one turn."""
    yield "D", 4, state
    if fault in ("blank", "duplicate"):
        return
    more = 3 * (fault == "truncated")
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
    if kept:
        yield "K", more, kept
    yield "R", 3 + more, 3 if NEXT[state] == "a" else 2


def _best(turns):
    """turns: (role, fault); whole audits by state, with inserts spread before, between and behind."""
    best = {0: (0, "")}

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for s, (cost, audit) in list(best.items()):
                to = 3 if NEXT[s] == "a" else 2
                best[to] = min(best.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return best

    for role, fault in turns:
        new = {}
        for s, (cost, audit) in inserted(best).items():
            for letter, more, to in _moves(s, role, fault):
                new[to] = min(new.get(to, (10**9, "")), (cost + more, audit + letter))
        best = new
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def _faults(turns):
    seen, out = set(), []
    for role, text in turns:
        last = next((c for c in reversed(text) if c not in SPACES), None)
        out.append("blank" if last is None else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def _repaired(turns, audit):
    left, state, lines = list(turns), 0, []
    for letter in audit:
        role, text = ("", "") if letter == "I" else left.pop(0)
        if letter == "D":
            continue
        new = role if letter == "K" else {"u": "user", "a": "assistant"}[NEXT[state]]
        state = {"s": 1, "u": 2, "a": 3}[new[0]]
        lines.append(f"{new}:{text}")
    return "\n".join(lines)


def _expected(rows):
    """Every conversation's row from those of the table."""
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        kept += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        turns = [r[1:] for r in found]
        faults = _faults(turns)
        cost, audit = _best([(role, fault) for (role, _), fault in zip(turns, faults, strict=True)])
        numbers = {r[0] for r in found if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        sha = hashlib.sha256(_repaired(turns, audit).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=str)


def _kinds(turns):
    return bytes(8 if f in ("blank", "duplicate") else ("sua".find(r[:1]) if r[:1] and r[:1] in "sua" else 3) + 4 * (f == "truncated") for r, f in turns)


def _own(kinds, cut):
    solver = repair.Solver()
    stretches = [[solver.ahead(repair.start(s), kinds[k : k + cut]) for s in range(4)] for k in range(0, len(kinds), cut)]
    vector = repair.start(0)
    for one in stretches:
        vector = repair.composed([vector], one)[0]
    last = repair.last_state(vector)
    states = [0, *repair.crossings(stretches, 0, last)]
    audit = "".join(solver.solve(kinds[k * cut : (k + 1) * cut], states[k], states[k + 1]) for k in range(len(stretches)))
    return vector[0][last] + 3 * len(repair.ENDINGS[last]), audit + repair.ENDINGS[last]


@pytest.mark.parametrize("cut", [1, 2, 5, 100])
def test_divide_and_conquer_is_the_plain_table(cut):
    rng = random.Random(cut)
    for _ in range(1500):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "user", "assistant", "", "Sys"]), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(1, 14))]
        assert _own(_kinds(turns), cut) == _best(turns), turns


def test_plain_table_is_the_best_of_all_edits():
    """All strings of edits up to a length, read off the contract."""
    def worth(turns, audit):
        state, cost, at = 0, 0, 0
        for letter in audit:
            if letter == "I":
                state, cost = (3 if NEXT[state] == "a" else 2), cost + 3
                continue
            if at == len(turns):
                return None
            found = {x: (c, s) for x, c, s in _moves(state, *turns[at])}.get(letter)
            if found is None:
                return None
            cost, state, at = cost + found[0], found[1], at + 1
        return cost if at == len(turns) and state in (0, 3) else None

    rng = random.Random(4)
    for _ in range(60):
        turns = [(rng.choice("suat"), rng.choice(["", "blank", "truncated"])) for _ in range(rng.randrange(0, 4))]
        every = ("".join(x) for n in range(7) for x in itertools.product("DIKR", repeat=n))
        assert _best(turns) == min((c, a) for a in every if (c := worth(turns, a)) is not None)


def test_query_is_brute_force_on_whole_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in queries.op12_conversation_repair(spark, data).collect()]
    assert sorted(got, key=str) == _expected(rows)


def test_long_conversations_go_over_partitions_and_blocks(spark, monkeypatch):
    """One conversation has half of all turns, many of them equal."""
    monkeypatch.setattr(repair, "BLOCK", 64)
    rng = random.Random(6)
    line = lambda: (rng.choice(["user", "assistant", "user", "system", "tool"]), rng.choice(["Yes.", "No", " ", "What?", f"Line {rng.randrange(400)}.", f"cut {rng.randrange(400)}"]))
    rows = [(7, k if k % 5 else None, *line()) for k in range(1500)] + [(c, t, *line()) for c in range(200, 500) for t in range(rng.randrange(1, 9))]
    rows += [(8, 3, "user", "Same.")] * 700
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = [tuple(r) for r in repair.digest(repair.repair(repair.damage(table)), table).collect()]
    assert sorted(got, key=str) == _expected(rows)
    by_block = repair.repair(repair.damage(table), whole=False)
    assert by_block.count() == sum(len(r[7]) for r in got)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, None, "", ""), (1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 5, "assistant", "Ho."), (2, -(2**63), "user", "A."), (2, 2**63 - 1, "assistant", "B."), (3, 1, "s", "x" * 300_000 + ".")]
    rows += [(4, t, "user\x00ü", "中。 ") for t in range(3)]
    spark_rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'p' AS place", "1 AS part", "'k' AS kind")
    got = {r.conv_id: tuple(r) for r in repair.digest(repair.repair(repair.damage(spark_rows)), spark_rows).collect()}
    want = {r[0]: r for r in _expected(rows)}
    assert set(got) == {None, 1, 2, 3, 4} and {k: v for k, v in got.items() if k != 2} == {k: v for k, v in want.items() if k != 2}
    assert got[2][2:] == want[2][2:]  # gaps are modulo 2^64
    nothing = spark_rows.limit(0)
    assert repair.digest(repair.repair(repair.damage(nothing)), nothing).collect() == []
