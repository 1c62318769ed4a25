"""The set-similarity join against all pairs: every class is found, whatever hubs, stars and classes leave out on the way."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import overlap, similarity

LEAST = 0.8


def _shingles(text, width=5):
    w = text.split()
    return {" ".join(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))}


def _classes(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _family(rng, name, size, edits):
    base = [f"{name}w{k}" for k in range(140)]
    out = []
    for _ in range(size):
        words = list(base)
        for at in rng.sample(range(140), rng.choice(edits)):
            kind = rng.randrange(3)
            words[at] = "" if kind == 0 else rng.choice([f"x{rng.randrange(9)}", f"y{rng.randrange(10**6)}"])
        out.append(" ".join(w for w in words if w))
    return out


def _texts(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = _family(rng, "a", 70, [1, 2, 3, 4]) + _family(rng, "b", 50, [0, 2, 3, 5]) + _family(rng, "c", 40, [2, 3])
    texts += [" ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) + f" {passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(8))) for _ in range(60)]
    texts += ["one", "two words", "", passage, passage + " end"]
    rng.shuffle(texts)
    return dict(enumerate(dict.fromkeys(texts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_hubs_stars_and_candidates_leave_no_class_apart(spark, seed):
    texts = _texts(seed)
    sets = {i: _shingles(t) for i, t in texts.items()}
    links = [(i, j) for i in texts for j in texts if i < j and len(sets[i] & sets[j]) >= LEAST * len(sets[i] | sets[j])]
    want = _classes(texts, links)
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, text string").repartition(5)
    cut = overlap.word_shingles(5)
    posted = overlap.postings(frame, cut, LEAST)
    assert {tuple(r) for r in overlap.verified(overlap.candidates(posted, LEAST), frame, cut, LEAST).collect()} == set(links)

    central = overlap.central(posted, LEAST)
    first = overlap.as_pairs(central).distinct()
    made = overlap.shingle_sets(first, frame, cut)
    near = [tuple(r) for r in overlap.similar(first, made, LEAST).collect()]
    assert set(near) <= set(links)
    deltas = overlap.star_deltas(central, made, LEAST)
    now = _classes(texts, near)
    labels = spark.createDataFrame([(i, c) for i, c in now.items()], "node long, component long")
    across = {tuple(r) for r in overlap.candidates_across(posted, labels, LEAST, deltas).collect()}
    inside = {tuple(r) for r in overlap.star_candidates(deltas, labels).collect()}
    # all links between classes so far are among the candidates
    missing = {p for p in links if now[p[0]] != now[p[1]]} - across - inside
    assert not missing
    assert {p for p in links if now[p[0]] != now[p[1]]} <= {tuple(r) for r in overlap.candidates_across(posted, labels, LEAST).collect()}
    assert _classes(texts, [*near, *[p for p in across | inside if p in set(links)]]) == want


def test_star_members_that_share_only_the_hubs_own_edits_are_no_candidates(spark):
    """A hub with an edit of its own: its difference is common to the star and must not bring all pairs of it."""
    base = [f"w{k}" for k in range(140)]
    edited = lambda *at: " ".join(f"e{a}x{b}" if (b := at.count(k)) and (a := k) else w for k, w in enumerate(base))
    texts = {0: edited(70)} | {i: edited(3 * i) for i in range(1, 21)} | {100 + i: edited(3 * i, 64 + 3 * i, 130 - i) for i in range(1, 15)}
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    stars = frame.where("id > 0").select("id", F.lit(0).cast("long").alias("hub"))
    made = overlap.shingle_sets(overlap.as_pairs(stars), frame, overlap.word_shingles(5))
    deltas = overlap.star_deltas(stars, made, LEAST)
    near = overlap.similar(overlap.as_pairs(stars), made, LEAST)
    linked = [r.right_id for r in near.collect()]
    labels = spark.createDataFrame([(i, 0) for i in [0, *linked]], "node long, component long")
    assert 20 <= len(linked) <= 24 and deltas.count() == 34
    assert overlap.star_candidates(deltas, labels).count() <= 40  # of some 14 * 20 pairs


def test_empty_texts(spark):
    frame = spark.createDataFrame([], "id long, text string")
    posted = overlap.postings(frame, overlap.word_shingles(5), LEAST)
    assert posted.count() == 0 and overlap.central(posted, LEAST).count() == 0


def _moved(spark) -> int:
    """Bytes that all shuffles so far have written."""
    return sum(e.totalShuffleWrite() for e in [spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0)])


def test_similar_pairs_are_all_pairs_of_unlike_sizes(spark):
    rng = random.Random(5)
    texts = []
    for family in range(6):
        base = [f"w{family}x{rng.randrange(500)}" for _ in range(rng.choice((30, 90, 400)))]
        for _ in range(12):
            own = base[: rng.randrange(len(base) // 3, len(base) + 1)]
            texts.append(" ".join(w if rng.random() > 0.15 else f"e{rng.randrange(300)}" for w in own))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    cut = overlap.word_shingles(1)
    sets = [set(cut(t.encode()).tolist()) for t in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b]) - 1e-9}
    got = [(r.left_id, r.right_id) for r in overlap.similar_pairs(rows, cut, 0.4).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_sketches_never_tell_similar_sets_apart():
    rng = np.random.default_rng(3)
    pool = rng.integers(-(2**63), 2**63 - 1, 4000)
    sets = [np.unique(pool[at : at + n]) for at, n in ((0, 1), (0, 2), (0, 17), (3, 40), (0, 900), (200, 900), (500, 1800), (0, 4000))]
    pairs = [(a, b) for a in range(len(sets)) for b in range(len(sets))]
    sketches = [overlap._sketch(x).tolist() for x in sets]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), pa.array([sketches[a] for a, _ in pairs], pa.list_(pa.int64())), pa.array([sketches[b] for _, b in pairs], pa.list_(pa.int64()))],
        names=["left_id", "right_id", "a", "b"],
    )
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    for least in (0.4, 0.8):
        kept = {(r["left_id"], r["right_id"]) for out in overlap._sketches_allow(least)(iter([batch])) for r in out.to_pylist()}
        assert kept >= {p for p in pairs if like(*p) >= least} and len(kept) < len(pairs)


def test_near_duplicates_do_not_shuffle_a_text_for_each_of_its_pairs(spark):
    rng = random.Random(7)
    base = [f"word{rng.randrange(5000)}" for _ in range(1000)]
    texts = [" ".join(w if rng.random() > 0.02 else f"edit{rng.randrange(9999)}" for w in base) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, small = _moved(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = similarity.near_duplicates(docs).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert n == 100 * 99 // 2
    assert _moved(spark) - before < 15 * sum(map(len, texts))


def test_bigrams_of_many_texts_are_those_of_each():
    rng = random.Random(11)
    words = ["a", "b", "sol", "the", "\u00e9", "abba", "baab", "w" * 24 + "x", "w" * 24 + "y", "w" * 40]
    texts = ["", " \n", "a b", "sol", "the", " sol\t", "a", "\u00e9"] + ["".join(rng.choice(words) + rng.choice((" ", "\n", " \t ", "\r\n")) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    sizes, grams = similarity.word_bigrams.many(pa.array([t.encode() for t in texts], pa.binary()).slice(0))
    found = [x.tolist() for x in np.split(grams, np.cumsum(sizes)[:-1])]

    def shingles(t):
        ws = t.split()
        own = {f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False) if len(f"{a} {b}".encode()) >= 4}
        return own or {ws[0] if len(ws) == 1 and len(ws[0].encode()) > 1 and ws[0] != "the" else ""}

    named = {}
    for t, own in zip(texts, found, strict=True):
        assert own == similarity.word_bigrams(t.encode()).tolist() and len(own) == len(set(own)) == len(shingles(t))
        for g in shingles(t):
            named.setdefault(g, set(own)).intersection_update(own)
    assert all(named.values())
    for t, own in zip(texts, found, strict=True):  # unequal bigrams have unequal digests
        assert all(any(named[g] == {d} for d in own) or len(named[g]) > 1 for g in shingles(t))
    assert len({d for own in found for d in own}) == len({g for t in texts for g in shingles(t)})


def test_pairs_stream_past_their_cells_in_any_blocks(spark, monkeypatch):
    for name, value in (("PAIR_ROWS", 7), ("SKETCH_BLOCK", 3000), ("SET_BLOCK", 3000), ("ROUND_BLOCKS", 3)):
        monkeypatch.setattr(overlap, name, value)
    rng = random.Random(6)
    texts = []
    for family in range(3):
        base = [f"w{family}x{rng.randrange(300)}" for _ in range(60)]
        texts += [" ".join(w if rng.random() > 0.15 else f"e{rng.randrange(300)}" for w in base) for _ in range(20)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "id long, text string")
    cut = overlap.word_shingles(1)
    sets = [set(cut(t.encode()).tolist()) for t in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b]) - 1e-9}
    got = [(r.left_id, r.right_id) for r in overlap.similar_pairs(rows, cut, 0.4).collect()]
    assert len(want) > 300 and set(got) == want and len(got) == len(want)
