"""An index of vectors: cells around centres (IVF), and in them residuals as product-quantised codes (PQ).

Centres and codebooks are fitted on a bounded sample; every vector is then given its cell, its code of one byte for each subspace and the length of what the
code leaves out (``error``). The index is two tables sorted by cell, so a search reads the row groups of the cells it probes: a narrow one of
codes, and the vectors themselves, of which only the candidates are compared exactly.

With ``probes`` a search looks into each query's nearest cells only, and into their codes first; ``calibrate`` chooses their number for a recall that is
measured against all rows. Without, it is exact: a cell is left out if its centre is further away than its radius and the bound on the k-th distance
allow, and the vectors of the others meet the queries by matrix products. Either way a task keeps each query's first ones only, so what moves
grows with the queries and the tasks, not with the pairs that are compared; their number grows with queries times vectors, where bounds leave nothing
out. Centres, codebooks and the cells' counts and radii are of bounded size and are sent to the tasks; queries are sent in portions of a checked size.

Defined results: null vectors, and those of another dimension than most of the sample, are not indexed; queries that are null or of another
dimension find nothing; ids are unique by contract; fewer than k vectors give fewer rows; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.operators.search import knn_batch
from lodestone.runtime import discard, materialize, scratch_path, ship_package

SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
CODES = 256
ROUNDS = 12
QUERIES_AT_ONCE = 1024  # that meet a batch, or all centres
SMALL_ROWS = 100_000  # candidates that are sent to the tasks


@dataclass(frozen=True)
class Index:
    path: str
    centres: np.ndarray  # cells x d
    codebooks: np.ndarray  # subspaces x codes x d / subspaces
    counts: np.ndarray  # of each cell
    radii: np.ndarray

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, cell int, code binary, error double").parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, cell int, vector array<double>").parquet(f"{self.path}/vectors")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def _bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above the distances, whatever rounding does to the product."""
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None]
    near = squares - 2 * a @ b.T
    error = squares * (4 * (a.shape[1] + 8) * np.finfo(np.float64).eps) + 1e-18
    return np.sqrt(np.maximum(near - error, 0)), np.sqrt(np.maximum(near + error, 0))


def _means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from a random start; a centre that loses its rows takes a random one."""
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([_distances(rows[at : at + 2048], centres).argmin(1) for at in range(0, len(rows), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        n = np.bincount(own, minlength=k)
        centres = np.where((n > 0)[:, None], sums / np.maximum(n, 1)[:, None], rows[rng.integers(0, len(rows), k)])
    return centres


def fit(vectors: DataFrame, *, cells: int | None = None, subspaces: int = 8, id_column: str = "vec_id", column: str = "embedding", sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centres and codebooks from at most about ``sample_rows`` vectors, drawn by a hash of the id. ``cells``: the square root of the number of vectors, at most
    MAX_CELLS and an eighth of the sample, where it is not given. A dimension that ``subspaces`` does not divide takes the next smaller divisor."""
    given = vectors.where(F.col(column).isNotNull() & F.col(id_column).isNotNull())
    total = given.count()
    share = max(1, -(-total // sample_rows))
    drawn = given.where(F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(share)) == 0).select(F.col(column).cast("array<double>").alias("v")).toArrow().column(0).to_pylist()
    if not drawn:
        return np.zeros((0, 0)), np.zeros((0, 0, 0))
    sizes = np.array([len(v) for v in drawn])
    d = int(np.bincount(sizes).argmax())
    rows = np.array([v for v in drawn if len(v) == d], np.float64)
    rng = np.random.default_rng(seed)
    k = min(cells or max(1, int(total**0.5)), MAX_CELLS, max(1, len(rows) // 8))
    centres = _means(rows, k, rng)
    rest = rows - centres[_distances(rows, centres).argmin(1)]
    parts = max((m for m in range(1, min(subspaces, d) + 1) if d % m == 0), default=1)
    books = np.stack([_means(rest[:, m * d // parts : (m + 1) * d // parts], min(CODES, len(rest)), rng) for m in range(parts)])
    return centres, books


def _decoded(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Residuals of codes (rows x subspaces)."""
    return np.concatenate([books[m][code[:, m]] for m in range(len(books))], axis=1)


def build(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding", path: str | None = None, **options) -> Index:
    """Fit the index and write every vector's cell and code under ``path`` (the shared folder, where it is not given)."""
    spark = vectors.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, "vector-index")
    centres, books = fit(vectors, id_column=id_column, column=column, **options)
    sent = spark.sparkContext.broadcast((centres, books))
    d = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = sent.value
        for batch in batches:
            rows = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, d)
            if not len(rows):
                continue
            cell = _distances(rows, centres).argmin(1)
            rest = rows - centres[cell]
            width = d // len(books)
            code = np.stack([_distances(rest[:, m * width : (m + 1) * width], book).argmin(1) for m, book in enumerate(books)], axis=1).astype(np.uint8)
            error = np.sqrt(((rest - _decoded(code, books)) ** 2).sum(1))
            far = np.sqrt((rest**2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array(far)], names=["id", "vector", "cell", "code", "error", "far"])

    rows = vectors.where(F.col(id_column).isNotNull() & (F.size(column) == d)).select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
    coded = materialize(rows.mapInArrow(run, "id long, vector array<double>, cell int, code binary, error double, far double"), "coded")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, columns in (("codes", ["id", "cell", "code", "error"]), ("vectors", ["id", "cell", "vector"])):
        # cells of any size are split over as many files as they need
        coded.select(*columns).repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id").write.option("parquet.block.size", str(16 << 20)).parquet(f"{path}/{name}")
    found = coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()  # a row a cell
    counts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in found:
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["r"]
    discard(coded)
    return Index(path, centres, books, counts, radii)


def _wider(distance: np.ndarray) -> np.ndarray:
    """As far as a vector may be whose score, to six places, is a tie."""
    score = 1 / (1 + distance) - 2e-6
    return np.where(score > 0, 1 / np.maximum(score, 1e-12) - 1, np.inf)


def _reach(index: Index, queries: np.ndarray, k: int) -> np.ndarray:
    """As far from each query as its k-th neighbour can be, by the cells' centres, radii and counts."""
    reach = _bounds(queries, index.centres)[1] + index.radii  # all of a cell is as near as this
    order = np.argsort(reach, axis=1)
    enough = np.cumsum(index.counts[order], axis=1) >= k
    at = np.where(enough.any(1), enough.argmax(1), len(index.counts) - 1)
    return np.where(enough.any(1), np.take_along_axis(reach, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], np.inf)


def cells_to_probe(index: Index, queries: np.ndarray, k: int, probes: int | None) -> np.ndarray:
    """queries x cells: which of them are read."""
    away, full = _bounds(queries, index.centres)[0], index.counts > 0
    if probes is not None:
        away[:, ~full] = np.inf
        order = np.argsort(away, axis=1, kind="stable")[:, :probes]
        out = np.zeros(away.shape, bool)
        np.put_along_axis(out, order, True, axis=1)
        return out & full
    return (away - index.radii <= _slack(_wider(_reach(index, queries, k)))[:, None]) & full


def _slack(distance: np.ndarray) -> np.ndarray:
    return distance * (1 + 1e-9) + 1e-9


class _Best:
    """The ``m`` least (value, id) that each of ``n`` queries has met: what a task keeps, whatever it reads."""

    def __init__(self, n: int, m: int):
        self.m, self.values, self.ids, self.cells = m, np.full((n, m), np.inf), np.full((n, m), np.iinfo(np.int64).max), np.zeros((n, m), np.int32)

    def add(self, query: np.ndarray, value: np.ndarray, id_: np.ndarray, cell: int) -> None:
        touched = np.unique(query)
        q = np.concatenate((query, np.repeat(touched, self.m)))
        v, i = np.concatenate((value, self.values[touched].reshape(-1))), np.concatenate((id_, self.ids[touched].reshape(-1)))
        c = np.concatenate((np.full(len(query), cell, np.int32), self.cells[touched].reshape(-1)))
        order = np.lexsort((i, v, q))
        starts = np.searchsorted(q[order], touched)  # every query has m rows at least
        first = order[(starts[:, None] + np.arange(self.m)).reshape(-1)].reshape(-1, self.m)
        self.values[touched], self.ids[touched], self.cells[touched] = v[first], i[first], c[first]

    def rows(self, names: np.ndarray, size: int = 2000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(names), size):
            query, place = np.nonzero(self.values[at : at + size] < np.inf)
            yield names[at + query], self.ids[at + query, place], self.cells[at + query, place], self.values[at + query, place]


def _runs(cell: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    return zip(edges[:-1], edges[1:], strict=True)


def _exact(index: Index, spark: SparkSession, names: np.ndarray, own: np.ndarray, wanted: int) -> DataFrame:
    """query_id, id, score: the first ``wanted`` of each query in each task, compared exactly.

    A task keeps each query's first so far; a cell is left out for a query if no vector in it can be nearer, and of a cell's vectors only
    those are compared exactly that the bounds of a matrix product allow.
    """
    reach = np.concatenate([_wider(_reach(index, own[at : at + QUERIES_AT_ONCE], wanted)) for at in range(0, len(own), QUERIES_AT_ONCE)])
    probed = np.zeros(len(index.counts), bool)
    for at in range(0, len(own), QUERIES_AT_ONCE):
        probed |= (_bounds(own[at : at + QUERIES_AT_ONCE], index.centres)[0] - index.radii <= _slack(reach[at : at + QUERIES_AT_ONCE])[:, None]).any(0)
    read = [int(c) for c in np.flatnonzero(probed & (index.counts > 0))]
    sent = spark.sparkContext.broadcast((names, own, reach, index.centres, index.radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, reach, centres, radii = sent.value
        best, limit = _Best(len(own), wanted), reach.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for a, b in _runs(cell):
                centre, rows = centres[cell[a]], vectors[a:b]
                for at in range(0, len(own), QUERIES_AT_ONCE):
                    part = slice(at, at + QUERIES_AT_ONCE)
                    asked = at + np.flatnonzero(_bounds(own[part], centre[None])[0][:, 0] - radii[cell[a]] <= _slack(limit[part]))
                    if not len(asked):
                        continue
                    least, most = _bounds(own[asked] - centre, rows - centre)
                    bound = limit[asked]
                    if b - a > wanted:
                        bound = np.minimum(bound, _wider(np.partition(most, wanted - 1, axis=1)[:, wanted - 1]))
                    i, j = np.nonzero(least <= _slack(bound)[:, None])
                    if not len(i):
                        continue
                    score = np.concatenate([np.round(1 / (1 + np.sqrt(((own[asked[x]] - rows[y]) ** 2).sum(1))), 6) for x, y in ((i[n : n + 20_000], j[n : n + 20_000]) for n in range(0, len(i), 20_000))])
                    best.add(asked[i], -score, ids[a:b][j], cell[a])
                    last = -best.values[asked, -1] - 2e-6  # of wanted rows, where there are so many
                    limit[asked] = np.minimum(limit[asked], np.where(last > 0, 1 / np.maximum(last, 1e-12) - 1, np.inf))
        for query, id_, _, value in best.rows(names):
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(id_), pa.array(-value)], names=["query_id", "id", "score"])

    return index.vectors(spark).where(F.col("cell").isin(read)).mapInArrow(run, "query_id long, id long, score double")


def _coded(index: Index, spark: SparkSession, names: np.ndarray, own: np.ndarray, probes: int, keep: int) -> tuple[DataFrame, list[int]]:
    """query_id, id, cell: the first ``keep`` by their codes in the cells that each query probes; and all these cells."""
    probed = np.concatenate([np.packbits(cells_to_probe(index, own[at : at + QUERIES_AT_ONCE], keep, probes), axis=1) for at in range(0, len(own), QUERIES_AT_ONCE)])
    sent = spark.sparkContext.broadcast((names, own, probed, index.centres, index.codebooks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, probed, centres, books = sent.value
        best = _Best(len(own), keep)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), len(books))
            for a, b in _runs(cell):
                everyone = np.flatnonzero((probed[:, cell[a] >> 3] >> (7 - (cell[a] & 7))) & 1)
                for asked in (everyone[at : at + QUERIES_AT_ONCE] for at in range(0, len(everyone), QUERIES_AT_ONCE)):
                    least, _ = _bounds(own[asked] - centres[cell[a]], _decoded(code[a:b], books))
                    bound = best.values[asked, -1]
                    if b - a > keep:
                        bound = np.minimum(bound, np.partition(least, keep - 1, axis=1)[:, keep - 1])
                    i, j = np.nonzero(least <= bound[:, None])
                    if len(i):
                        best.add(asked[i], least[i, j], ids[a:b][j], cell[a])
        for query, id_, cells, value in best.rows(names):
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(id_), pa.array(cells), pa.array(value)], names=["query_id", "id", "cell", "least"])

    read = [int(c) for c in np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(probed, axis=0))[: len(index.counts)])]
    found = index.codes(spark).where(F.col("cell").isin(read)).mapInArrow(run, "query_id long, id long, cell int, least double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("least", "id"))).where(F.col("r") <= keep).select("query_id", "id", "cell"), read


def search(index: Index, queries: DataFrame, k: int = 10, *, probes: int | None = None, refine: int = 8, exclude_self: bool = False, max_sent: int = DEFAULT.max_sent_vectors, depth: int = 0) -> DataFrame:
    """query_id, id, score, rank of the k nearest of each row of ``queries`` (query_id, query): 1 / (1 + distance).

    With ``probes`` the best ``refine`` times k codes of these cells are compared exactly; without, whatever can be among the first k. A task hands on at
    most so many rows of a query, however many it reads.
    """
    spark = queries.sparkSession
    ship_package(spark)
    d = index.centres.shape[1]
    given = queries.where(F.size("query") == d)
    n = given.count()
    if n > max_sent and depth <= 20:
        portions = -(-n // max_sent)
        bucket = F.pmod(F.xxhash64("query_id", F.lit(depth)), F.lit(portions))
        some = [search(index, queries.where(bucket == b), k, probes=probes, refine=refine, exclude_self=exclude_self, max_sent=max_sent, depth=depth + 1) for b in range(portions)]
        return reduce(DataFrame.unionByName, some)
    rows = given.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>").alias("query")).where("query_id is not null").toArrow().combine_chunks()
    if not rows.num_rows or not len(index.counts):
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    names, own = rows.column(0).to_numpy(), np.array(rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    wanted = k + int(exclude_self)
    if probes is None:
        scored = _exact(index, spark, names, own, wanted)
        if exclude_self:
            scored = scored.where("id <> query_id")
    else:
        keep = refine * wanted
        near, read = _coded(index, spark, names, own, probes, keep)
        stored = index.vectors(spark).where(F.col("cell").isin(read))
        if len(names) * keep <= SMALL_ROWS:
            near = F.broadcast(near)
        pairs = near.join(stored, ["cell", "id"])
        pairs = pairs.where("id <> query_id") if exclude_self else pairs
        order = np.argsort(names, kind="stable")
        sent = spark.sparkContext.broadcast((names[order], own[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, own = sent.value
            for batch in batches:
                if batch.num_rows:
                    away = own[np.searchsorted(names, batch.column(0).to_numpy())] - batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(1 / (1 + np.sqrt((away**2).sum(1))), 6))], names=["query_id", "id", "score"])

        scored = pairs.select("query_id", "id", "vector").mapInArrow(run, "query_id long, id long, score double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def scanned_share(index: Index, queries: np.ndarray, k: int, probes: int | None) -> float:
    """Mean share of the codes that a query reads."""
    return float((cells_to_probe(index, queries, k, probes) @ index.counts).mean() / max(1, index.counts.sum()))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "id", F.lit(True).alias("hit")), ["query_id", "id"], "left").agg(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0))).first()[0]
    return 1.0 if hit is None else float(hit)


def calibrate(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 10, *, target: float = 0.9, id_column: str = "vec_id", column: str = "embedding", exclude_self: bool = False) -> tuple[int, float]:
    """The least power of two of probes, at most all cells, whose measured recall on ``queries`` (a bounded set) is ``target`` or more, and that recall."""
    exact = materialize(knn_batch(vectors, queries, k, id_column=id_column, column=column, exclude_self=exclude_self), "exact")
    probes = 1
    while True:
        now = recall(search(index, queries, k, probes=probes, exclude_self=exclude_self), exact)
        if now >= target or probes >= len(index.counts):
            return probes, now
        probes *= 2
