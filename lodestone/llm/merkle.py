"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words, in SQL functions only.

A paragraph is a line with its line end; runs of up to RUN words with the white space around them are its
leaves, so that the leaves of a text, one after the other, are the text. A section is SECTION
paragraphs. A node's digest covers its children's in order: a leaf is 64 bits of XXH64, and so is a paragraph over its leaves, a section and the
root are SHA-256 over these, so that the root tests equality of whole texts (up to 64-bit collisions of runs), and where two trees differ, the differing sections and then their paragraphs locate the edit.

The fingerprint as a string: the root, a colon, and the leaves' digests (low 32 bits), with ``.`` between
paragraphs and ``/`` between sections. Likeness of two fingerprints: twice the leaf digests in common
over the sum of both, each counted once; of two empty texts 1.

Defined results: null text counts as the empty text, which has no section;
white space alone is a leaf; equal doc_ids are ordered by a hash of their text; of a single row the next
document is itself; rows without doc_id are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUN = 4
SECTION = 8
BUCKET_ROWS = 3000
MAX_BUCKETS = 4096


_LINES = rf"(?:[^\n]*+\n){{{SECTION}}}|(?:[^\n]*+\n){{0,{SECTION - 1}}}[^\n]++\z|(?:[^\n]*+\n){{1,{SECTION - 1}}}\z"
_LEAF = rf"\s*+(?:\S++\s*+){{1,{RUN}}}+|\s++"


def tree(text: Column) -> Column:
    """array<array<array<long>>>: sections, their paragraphs, their leaves' digests. Each level is cut from the one above it only."""
    leaves_of = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda x: F.xxhash64(x))
    own = lambda s: F.transform(F.filter(F.split(s, r"(?<=\n)"), lambda p: p != ""), leaves_of)
    return F.transform(F.regexp_extract_all(text, F.lit(_LINES), F.lit(0)), own)


def section_digest(section: Column) -> Column:
    """SHA-256 over the digests of the section's paragraphs, each over its leaves'."""
    return F.sha2(F.array_join(F.transform(section, lambda p: F.hex(F.xxhash64(p))), ",").cast("binary"), 256)


def root(nodes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(nodes, section_digest), ",").cast("binary"), 256)


def leaves(nodes: Column) -> Column:
    return F.flatten(F.flatten(nodes))


def to_string(nodes: Column) -> Column:
    short = lambda p: F.array_join(F.transform(p, lambda d: F.right(F.hex(d), F.lit(8))), "")
    parts = F.transform(nodes, lambda s: F.array_join(F.transform(s, short), "."))
    return F.concat(root(nodes), F.lit(":"), F.lower(F.array_join(parts, "/")))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of leaf digests, 0 to 1."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing(a: Column, b: Column) -> Column:
    """Indexes (from 0) of the paragraphs that differ, looked for below differing sections only; empty for equal trees."""

    def below(pair: Column, k: Column) -> Column:
        both = F.zip_with(pair["a"], pair["b"], lambda x, y: ~F.xxhash64(x).eqNullSafe(F.xxhash64(y)))
        at = F.filter(F.transform(both, lambda d, i: F.when(d, k * SECTION + i)), lambda i: i.isNotNull())
        only = F.coalesce(pair["a"], pair["b"])  # a section that one side lacks differs as a whole
        whole = F.transform(only, lambda _, i: k * SECTION + i)
        return F.when(section_digest(pair["a"]) == section_digest(pair["b"]), F.array().cast("array<int>")).when(pair["a"].isNull() | pair["b"].isNull(), whole).otherwise(at)

    return F.flatten(F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), below))


def _range_of(value: Column, cuts: list[int], step: int = 64) -> Column:
    """How many of the sorted ``cuts`` are not above ``value``: every 64th is looked at, then those up to the next."""
    below = lambda some: F.size(F.filter(some, lambda c: c <= value))
    literals = lambda some: F.array(*[F.lit(c).cast("long") for c in some]) if some else F.array().cast("array<bigint>")
    if len(cuts) <= step:
        return below(literals(cuts))
    parts = F.array(*[literals(cuts[k : k + step]) for k in range(0, len(cuts), step)])
    coarse = F.greatest(below(literals(cuts[::step])) - 1, F.lit(0))
    return coarse * step + below(F.get(parts, coarse))


def with_next(docs: DataFrame, prepare) -> DataFrame:
    """Each row beside the next one by ascending doc_id (after the last: the first), as ``next_<column>``.

    Rows are dealt into ranges of doc_id by approximate quantiles, at most MAX_BUCKETS of them; the first
    row of each range is also sent to the range before it, so that a window within ranges sees it.
    ``prepare`` adds columns after the shuffle.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null")
    n = rows.count()
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(MAX_BUCKETS, n, max(least, n // BUCKET_ROWS)))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 20_000)).first()[0] if buckets > 1 else []
    dealt = rows.withColumn("__bucket", _range_of(F.col("doc_id"), sorted({int(c) for c in cuts or []})))
    first = {r[0]: r[1] for r in dealt.groupBy("__bucket").agg(F.min("doc_id")).collect()}
    names = sorted(first)
    size = (names[-1] if names else 0) + 1
    before = {b: names[k - 1] for k, b in enumerate(names)}  # the first range wraps round to the last
    firsts = F.array(*[F.lit(first.get(k)).cast("long") for k in range(size)])
    befores = F.array(*[F.lit(before.get(k)).cast("int") for k in range(size)])
    at = F.col("__bucket")
    places = F.when(
        F.get(firsts, at) == F.col("doc_id"),
        F.array(F.struct(at.alias("b"), F.lit(0).alias("g")), F.struct(F.get(befores, at).alias("b"), F.lit(1).alias("g"))),
    ).otherwise(F.array(F.struct(at.alias("b"), F.lit(0).alias("g"))))
    spread = dealt.withColumn("__place", F.explode(places)).withColumn("__b", F.col("__place.b")).withColumn("__g", F.col("__place.g")).drop("__place", "__bucket")
    held = prepare(spread.repartition("__b"))
    own = [c for c in held.columns if c not in ("__b", "__g")]
    w = Window.partitionBy("__b").orderBy("__g", "doc_id", F.xxhash64("text"))
    led = held.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in own if c != "doc_id"])
    return led.where("__g = 0").drop("__b", "__g")


def fingerprint_with_edit(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited and the trees of both, with likeness to the edited text's and the next document's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(rows, lambda df: df.withColumn("tree", tree(F.col("text"))))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    out = led.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_tree", tree(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        "text",
        "edited",
        "tree",
        "edited_tree",
        likeness(leaves(F.col("tree")), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(leaves(F.col("tree")), leaves(F.col("next_tree"))).alias("near_next"),
    )
