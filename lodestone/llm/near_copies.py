"""Classes of near copies: texts linked by the Jaccard similarity of their word shingles, every link found.

Candidates come from two sides. SimHash (``simhash.links``) gives the pairs of fingerprints that differ in few bits, which
are most near copies, but not all: at a Jaccard similarity of 0.8 fingerprints differ in some ten bits, and a limit that wide no longer selects.
An exact join (``operators.overlap``) gives the rest: first each text meets two others, of the smallest and of the most central ids of its shingles those with
which it shares most, which joins large classes by two pairs a text. A central text and those that chose it are a star. Then come all pairs that the prefix filter allows between different classes so far, for texts of one star on what makes them differ from its centre.
Only pairs whose whole shingle sets are similar enough become links.

A text is named by 64 bits of its hash, so copies are one node. Defined results: fewer words than a shingle are one shingle; texts
without words are copies of each other; a repeated doc_id joins the classes of its texts; null doc_ids are not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.graph import components
from lodestone.operators import overlap
from lodestone.runtime import discard, materialize


def _labels(pairs: DataFrame) -> DataFrame:
    return components(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))


def fingerprint_pairs(texts: DataFrame, width: int, limit: int) -> DataFrame:
    """left_id, right_id: texts whose fingerprints are equal or linked; of equal fingerprints each beside the smallest id."""
    prints = materialize(simhash.fingerprints(texts.withColumnRenamed("id", "doc_id"), width=width).distinct(), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = simhash.links(nodes, limit=limit)
    left, right = (nodes.select(F.col("fp").alias(x), F.col("node").alias(n)) for x, n in (("x", "a"), ("y", "b")))
    linked = found.join(left, "x").join(right, "y").select("a", "b")
    equal = prints.join(nodes, "fp").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    return linked.union(equal).select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def classes(docs: DataFrame, *, width: int = 5, least: float = 0.8, limit: int = simhash.LIMIT) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over links of Jaccard ``least`` or more."""
    cut = overlap.word_shingles(width)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select(F.xxhash64("text").alias("id"), "text")
    members = materialize(rows.select("doc_id", F.xxhash64("text").alias("id")), "members")
    posted = overlap.postings(texts, cut, least)
    central = materialize(overlap.central(posted, least), "central")
    first = fingerprint_pairs(texts, width, limit).union(overlap.as_pairs(overlap.hubs(posted, least))).union(overlap.as_pairs(central))
    first = materialize(first.distinct(), "candidates")
    sets = overlap.shingle_sets(first, texts, cut)
    near = overlap.similar(first, sets, least)
    deltas = materialize(overlap.star_deltas(central, sets, least), "deltas")
    for done in (first, sets, central):
        discard(done)
    labels = _labels(near)
    further = overlap.candidates_across(posted, labels, least, deltas).union(overlap.star_candidates(deltas, labels))
    more = overlap.verified(further.distinct(), texts, cut, least)
    for done in (posted, deltas):
        discard(done)
    named = materialize(_labels(near.union(more)), "classes")
    of = members.join(named, members.id == named.node, "left").select("doc_id", F.coalesce("component", "id").alias("class"))
    # classes are named by their smallest doc_id; those that a repeated doc_id is in become one
    first = of.groupBy("class").agg(F.min("doc_id").alias("first"))
    named = materialize(of.join(first, "class").select("doc_id", "first").distinct(), "firsts")
    least_first = named.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("z")).where("a <> z").drop("z")
    joined = components(named.join(least_first, "doc_id").select("a", F.col("first").alias("b")))
    out = named.join(joined, named["first"] == joined.node, "left").select("doc_id", F.coalesce("component", named["first"]).alias("component_id"))
    return out.distinct()
