"""Full-text search by an impact-ordered inverted index in blocks.

A posting's impact is its part of the BM25 score without the term's weight. A term's postings are dealt into layers of falling impact, and each layer is
cut into blocks of at most BLOCK postings in order of ids; a block carries its greatest impact and its least and greatest id. A search
reads layers, the ones that can add most first, until what is unread cannot lift a document it has not seen into the first k; the few documents whose place is
still open then have their missing terms looked up, in the blocks whose ids allow them. The result is that of scoring every document.

The index is published as a whole (``operators.publish``): a reader sees the old one or the new one. A term however common is spread over as many
partitions and blocks as it needs; per query the driver sees LAYERS rows for each term and the documents in doubt, a bounded number (beyond it the
layers are read on).

Defined results: words are what stands between ASCII white space, in lower case; null texts have no words but count as documents; ids are unique by
contract; ties of six places go by id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.operators import publish
from lodestone.runtime import discard, materialize, ship_package

LAYERS = 32
BLOCK = 1024
FIRST_READ = 4_000  # postings of a search's first read; each later one is four times as large
IN_DOUBT = 2_000  # documents whose missing terms are looked up
INTERVALS = 64
_BLOCKS = "term string, layer int, most double, low long, high long, n int, ids array<long>, counts array<int>, lengths array<int>"


@dataclass
class Found:
    """What a search has read."""

    rows: DataFrame
    blocks_read: int = 0
    blocks_of_terms: int = 0
    reads: list[int] = field(default_factory=list)  # postings


def _counted(docs: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, term, f, n: how often each word of a document comes, and the document's number of words; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                lists = pc.ascii_split_whitespace(part.column(1))
                row, word = pc.list_parent_indices(lists), pc.list_flatten(lists)
                keep = pc.greater(pc.binary_length(word), 0)
                row, coded = row.filter(keep).to_numpy(), word.filter(keep).dictionary_encode()
                size = max(len(coded.dictionary), 1)
                found, f = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
                rows, n = found // size, np.bincount(row, minlength=part.num_rows)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), coded.dictionary.take(pa.array(found % size)), pa.array(f, pa.int32()), pa.array(n[rows], pa.int32())], names=["id", "term", "f", "n"],
                    )

    lower = F.lower(F.make_valid_utf8(F.coalesce(column, F.lit(""))))
    return docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), lower.alias("text")).mapInArrow(run, "id long, term string, f int, n int")


def _impact(f: Column, n: Column, mean: float, config: Config, weight: Column | float = 1.0) -> Column:
    return weight * f * (config.bm25_k1 + 1) / (f + config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * n / mean))


def _cut(postings: DataFrame) -> DataFrame:
    """Blocks of postings that come sorted by term, layer and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _BLOCKS.split(", ")]
        types = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        terms, own = pa.array([], pa.string()), [np.zeros(0)] * 5  # the block that may go on

        def closed(k: int, starts: np.ndarray) -> pa.RecordBatch:
            """The first ``k`` postings, whose blocks begin at ``starts``."""
            ends = np.append(starts[1:], k)
            layer, ids, counts, lengths, impact = (c[:k] for c in own)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(starts, k), pa.int32()), pa.array(c, t.value_type)) for c, t in zip((ids, counts, lengths), types[6:], strict=True)]
            columns = [layer[starts], np.maximum.reduceat(impact, starts), ids[starts], ids[ends - 1], ends - starts]
            return pa.RecordBatch.from_arrays([terms.take(pa.array(starts)), *[pa.array(c, t) for c, t in zip(columns, types[1:6], strict=True)], *lists], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            terms = pa.concat_arrays([terms, batch.column(0)])
            own = [np.concatenate((x, c.to_numpy())) if len(x) else c.to_numpy() for x, c in zip(own, batch.columns[1:], strict=True)]
            code = terms.dictionary_encode().indices.to_numpy()
            first = np.concatenate(([True], (code[1:] != code[:-1]) | (own[0][1:] != own[0][:-1])))
            at = np.arange(len(code))
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(first, at, 0))) % BLOCK == 0)
            k = starts[-1]
            if k:
                yield closed(k, starts[:-1])
            terms, own = terms.slice(k), [c[k:] for c in own]
        if len(terms):
            yield closed(len(terms), np.zeros(1, np.int64))

    return postings.mapInArrow(run, _BLOCKS)


def build(docs: DataFrame, root: str, *, id_column: str = "doc_id", column: str = "text", config: Config = DEFAULT) -> None:
    """Index the documents under ``root``, in place of what is published there."""
    spark = docs.sparkSession
    ship_package(spark)
    counted = materialize(_counted(docs, id_column, column), "postings")
    corpus = docs.where(F.col(id_column).isNotNull()).agg(F.count("*").alias("docs")).crossJoin(counted.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("words")))  # one row each
    total = corpus.first()
    mean = max(total["words"] / max(total["docs"], 1), 1e-9)
    impact = _impact(F.col("f"), F.col("n"), mean, config)
    layer = F.least(F.lit(LAYERS - 1), F.floor(impact / (config.bm25_k1 + 1) * LAYERS)).cast("int")
    rows = counted.select("term", layer.alias("layer"), "id", "f", "n", impact.alias("impact"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(_cut(rows.repartitionByRange(parts, "term", "layer", "id").sortWithinPartitions("term", "layer", "id")), "blocks")
    layers = blocks.groupBy("term", "layer").agg(F.count("*").alias("blocks"), F.sum("n").alias("postings"), F.max("most").alias("most"))
    corpus = spark.createDataFrame([(total["docs"], mean)], "docs long, mean double")
    # blocks come as they were cut, by ranges of term, layer and id: they are not dealt and sorted again
    publish.publish(spark, root, {"blocks": blocks, "layers": layers, "corpus": corpus}, sort={"layers": ["term", "layer"]})
    discard(counted)
    discard(blocks)


def search(spark: SparkSession, root: str, query: str, k: int = 10, *, config: Config = DEFAULT) -> Found:
    """id, score of the k best documents by BM25."""
    folder = publish.published(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no index is published under {root}")
    terms = sorted(set(query.lower().split()))
    corpus = spark.read.parquet(f"{folder}/corpus").first()
    rows = spark.read.parquet(f"{folder}/layers").where(F.col("term").isin(terms)).collect()  # at most LAYERS a term
    df: Counter = Counter()
    for r in rows:
        df[r["term"]] += r["postings"]
    weight = {t: math.log(1 + (corpus["docs"] - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
    waiting = sorted(rows, key=lambda r: (-weight[r["term"]] * r["most"], r["term"], -r["layer"]))
    out = Found(spark.createDataFrame([], "id long, score double"), blocks_of_terms=sum(r["blocks"] for r in rows))
    present = [t for t in terms if df[t]]
    if not present or k < 1:
        return out
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    own_weight = F.element_at(F.create_map(*[x for t in present for x in (F.lit(t), F.lit(weight[t]))]), F.col("term"))
    score = _impact(F.col("f"), F.col("n"), corpus["mean"], config, own_weight)

    def postings(some: DataFrame) -> DataFrame:
        zipped = some.select("term", F.explode(F.arrays_zip("ids", "counts", "lengths")).alias("p"))
        return zipped.select("term", F.col("p.ids").alias("id"), F.col("p.counts").alias("f"), F.col("p.lengths").alias("n")).select("term", "id", score.alias("s"))

    def of(some: list) -> Column:
        return _any([(F.col("term") == r["term"]) & (F.col("layer") == r["layer"]) for r in some])

    budget, read, partial, ahead = FIRST_READ, [], None, {}
    while True:
        taken = 0
        while waiting and (taken == 0 or taken < budget):
            read.append(waiting.pop(0))
            taken += read[-1]["postings"]
        budget *= 4
        out.reads.append(taken)
        ahead = {t: max((weight[t] * r["most"] for r in waiting if r["term"] == t), default=0.0) for t in present}
        if partial is not None:
            discard(partial)
        own = postings(blocks.where(of(read))).groupBy("id").agg(F.sum("s").alias("sum"), F.collect_set("term").alias("seen"))  # at most the query's terms
        unseen = sum((F.when(F.array_contains("seen", t), 0.0).otherwise(ahead[t]) for t in present), F.lit(0.0))
        partial = materialize(own.withColumn("most", F.col("sum") + unseen), "partial")
        best = partial.orderBy(F.desc("sum"), "id").limit(k).agg(F.min("sum"), F.count("*")).first()
        least = best[0] - 2e-6 if best[1] == k else -1.0
        if waiting and sum(ahead.values()) >= least:
            continue
        doubtful = partial.where(F.col("most") >= least)
        if waiting and doubtful.where("most > sum").limit(IN_DOUBT + 1).count() > IN_DOUBT:
            continue
        break
    out.blocks_read = sum(r["blocks"] for r in read)
    exact = postings(blocks.where(of(read))).join(doubtful.select("id"), "id", "left_semi")
    open_ = [r["id"] for r in doubtful.where("most > sum").select("id").collect()] if waiting else []  # at most IN_DOUBT
    if open_:
        spans = _any([(F.col("low") <= b) & (F.col("high") >= a) for a, b in _intervals(sorted(open_))])
        more = blocks.where(of(waiting)).where(spans)
        out.blocks_read += more.count()
        exact = exact.unionByName(postings(more).where(F.col("id").isin(open_)))
    # terms are added in their order, as a scan adds them
    scored = exact.groupBy("id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("term", "s"))), F.lit(0.0), lambda t, x: t + x["s"]).alias("score"))
    out.rows = materialize(scored.select("id", F.round("score", 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k), "found")
    discard(partial)
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _intervals(ids: list[int]) -> list[tuple[int, int]]:
    """At most INTERVALS that hold the ids, parted at the widest gaps."""
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: INTERVALS - 1]
    edges = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(edges, edges[1:], strict=False)]
