"""The trie of conversations' beginnings against dictionaries of whole prefixes."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import queries, turn_trie


def _expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn, role or "", text or ""))
    for found in by.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
    members, ends = {}, {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = by.get(c - int(math.fmod(c, 5)), [])
        turns = [r[1:] for r in base[:h] + own[h:]]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        worth = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += worth
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -(2**63), len(m), children[n], leaves[n], saved[n], digest(n)) for n, m in members.items())


def _got(table, segment=turn_trie.SEGMENT):
    rows = turn_trie.nodes(*turn_trie.rebuilt(turn_trie.sequences(table)), segment).collect()
    return sorted((r.conv_id, r.depth, -(2**63) if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows)


def test_double_arrays_hold_exactly_their_sequences():
    rng = random.Random(1)
    for spread in (2, 5, 40):
        some = sorted({tuple(rng.randrange(spread) for _ in range(rng.randrange(9))) for _ in range(300)})
        codes, offsets = np.array([c for x in some for c in x], np.int64), np.concatenate(([0], np.cumsum([len(x) for x in some])))
        trie = turn_trie.DoubleArray(codes, offsets)
        nodes = {x[:d] for x in some for d in range(len(x) + 1)}
        assert (trie.check >= 0).sum() == len(nodes)
        reached = set()
        for x in nodes:
            at = np.zeros(1, np.int64)
            for c in x:
                at = trie.step(at, np.array([c]))
            reached.add(int(at[0]))
        assert len(reached) == len(nodes)
        with pytest.raises((ValueError, IndexError)):
            trie.step(np.zeros(1, np.int64), np.array([spread + 1]))


def test_query_is_brute_force_on_whole_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(-(2**63) if v is None else v for v in r) for r in queries.op13_conversation_trie(spark, data).collect())
    assert got == _expected(rows)


@pytest.mark.parametrize(("segment", "shard"), [(1024, 60_000), (1024, 20), (3, 20), (2, 1), (1, 7)])
def test_shards_and_segments_change_nothing(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(turn_trie, "SHARD", shard)
    rng = random.Random(segment + shard)
    openings = [[(rng.choice("ua"), f"line {rng.randrange(4)}") for _ in range(11)] for _ in range(3)]
    rows = []
    for c in [*range(-7, 90), 200, 203, 1000]:
        turns = openings[rng.choice([0, 0, 0, 1, 2])][: rng.randrange(12)] + [(rng.choice("ua"), f"own {rng.randrange(3)}") for _ in range(rng.randrange(4))]
        rows += [(c, k if rng.random() < 0.9 else None, r, t) for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert _got(table, segment) == _expected(rows)


def test_hot_conversation_and_hot_beginning(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "SHARD", 50)
    rows = [(3, k, "user", f"long {k}") for k in range(400)] + [(c, k, "user", "hello") for c in range(1000, 1300) for k in range(2)]
    rows += [(c, 2, "user", f"then {c % 4}") for c in range(1000, 1300, 3)] + [(4, 0, "user", "long 0")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert _got(table, 64) == _expected(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "a", "b"), (1, None, None, None), (1, None, None, None), (1, 2, "ü", "中" * 50_000), (5, 1, "", ""), (6, 1, "a", "b"), (6, 1, "a", "b"), (6, 1, "b", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS size", "'y' AS place", "1 AS depth")
    assert _got(table) == _expected(rows)
    assert _got(table.limit(0)) == []
    assert _got(table.where("conv_id is null")) == []
