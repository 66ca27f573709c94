"""Vector operators: upsert, delete, exact and approximate top-k, pair similarity, index facts.

A vector table has key, id and vec (array<float>); math is in double precision.
Exact search multiplies each Arrow batch with the queries and hands on only the
best k of each task. Ties go to the lesser id.

A query meets the vectors of its own dimension; one whose dimension no vector has finds nothing, as
do null vectors and those with null elements, which no search returns either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.functions import expr
from keelstone.functions.ranking import top
from keelstone.session import prepare

#: Bytes of query vectors that are broadcast at a time; more queries take more passes.
QUERY_BYTES = 32 << 20
#: Rows that the cells of an index are fitted on, at most.
FIT_ROWS = 20_000
#: Rows of a cell that one task compares; larger cells are split by id.
CELL_ROWS = 50_000
MAX_CELLS = 1024


def upsert(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """Last writer wins by key and id; a key's dimension is that of its first vector
    (least seq), and vectors of another size are refused. changes: key, id, vec, seq."""
    both = vectors.select("key", "id", "vec", F.lit(-1).cast("bigint").alias("seq")).union(changes.select("key", "id", "vec", "seq"))
    dim = both.groupBy("key").agg(F.min_by(F.size("vec"), "seq").alias("dim"))
    fit = both.join(dim, "key").filter(F.size("vec") == F.col("dim"))
    return fit.groupBy("key", "id").agg(F.max_by("vec", "seq").alias("vec"))


def delete(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, ["key", "id"], "left_anti")


def facts(vectors: DataFrame) -> DataFrame:
    """Per key: dimension and count."""
    return vectors.groupBy("key").agg(F.max(F.size("vec")).cast("bigint").alias("dimension"), F.count(F.lit(1)).alias("count"))


def pairs(vectors: DataFrame, wanted: DataFrame, metric: str = "cosine") -> DataFrame:
    """(key, id1, id2, score) by two equi-joins. As a pair's metric only l2 is told apart."""
    kernel = expr.l2 if metric.lower() in ("l2", "euclidean") else expr.cosine
    a = vectors.select("key", F.col("id").alias("id1"), F.col("vec").alias("v1"))
    b = vectors.select("key", F.col("id").alias("id2"), F.col("vec").alias("v2"))
    return wanted.join(a, ["key", "id1"]).join(b, ["key", "id2"]).select("key", "id1", "id2", kernel(F.col("v1"), F.col("v2")).alias("score"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as doubles; rows of another size or null become NaN."""
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count == 0 and (sizes == dim).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    out = np.full((len(column), dim), np.nan)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dim and None not in v:
            out[i] = v
    return out


def scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) of the metric; NaN where a row does not fit."""
    inner = queries @ rows.T
    if metric in ("dot", "innerproduct"):
        return inner
    if metric in ("l2", "euclidean"):
        out = np.empty_like(inner)
        for i, q in enumerate(queries):  # differences, not the expanded square, keep near pairs exact
            d = rows - q
            out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    return np.where(norms == 0, np.where(np.isnan(inner), np.nan, 0.0), inner / np.where(norms == 0, 1, norms))


def _best(value: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least values, ties by id; NaN never counts."""
    good = np.flatnonzero(~np.isnan(value))
    if len(good) > k:
        edge = np.partition(value[good], k - 1)[k - 1]
        good = good[value[good] <= edge]
    return good[np.lexsort((ids[good], value[good]))][:k]


_FOUND = "qid bigint, id bigint, score double"


def _rows(qid, ids, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["qid", "id", "score"])


def _whole(df: DataFrame) -> DataFrame:
    """The rows whose vectors are there, and without null elements."""
    return df.filter(F.coalesce((F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull()), F.lit(False)))


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(qid, id, score, rank): exact top-k of each query over all vectors (id, vec) of its dimension.
    queries: qid, vec. Queries go out in blocks of QUERY_BYTES at most."""
    spark = prepare(vectors.sparkSession)
    metric = metric.lower()
    nearer = 1 if metric in ("l2", "euclidean") else -1
    queries = _whole(queries)
    blocks = []
    for dim, n in sorted(tuple(r) for r in queries.groupBy(F.size("vec")).count().collect()):  # a row a dimension
        parts = -(-n * dim * 8 // QUERY_BYTES)
        blocks += [(dim, parts, b) for b in range(parts)]
    out = vectors.limit(0).selectExpr("cast(id as bigint) as qid", "cast(id as bigint) as id", "0d as score")
    for at, (dim, parts, b) in enumerate(blocks):
        part = queries.filter(F.size("vec") == dim)
        part = part if parts == 1 else part.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == b)
        rows = part.select("qid", "vec").collect()  # one block
        shipped = spark.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), np.array([r.vec for r in rows], np.float64).reshape(-1, dim)))

        def run(batches, shipped=shipped):
            qids, q = shipped.value
            held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(qids)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                s = scores(q, _matrix(batch.column(1), q.shape[1]), metric)
                for i in range(len(qids)):
                    at = _best(nearer * s[i], ids, k)
                    ids_i, s_i = np.concatenate([held[i][0], ids[at]]), np.concatenate([held[i][1], s[i][at]])
                    at = _best(nearer * s_i, ids_i, k)
                    held[i] = ids_i[at], s_i[at]
            if len(qids):
                yield _rows(np.repeat(qids, [len(h[0]) for h in held]), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        got = vectors.select(F.col("id").cast("bigint").alias("id"), "vec").mapInArrow(run, _FOUND)
        out = got if at == 0 else out.union(got)
    return top(out, ["qid"], [(F.col("score") * nearer).asc(), F.col("id").asc()], k, "rank")


@dataclass
class Cells:
    """An inverted-file index's cells: centres in the metric's own space, so that the rows that a query
    is near to lie in the cells that it is near to. Cosine: directions. l2: the vectors
    themselves. dot: one more element lifts every vector to the length of the longest, and
    the inner product orders them as their angles to the query do."""

    centres: np.ndarray
    metric: str = "cosine"
    longest: float = 0.0

    def lifted(self, m: np.ndarray, asked: bool = False) -> np.ndarray:
        """Rows, or queries, in the space of the centres."""
        if self.metric == "l2":
            return m
        if self.metric == "dot":
            rest = np.zeros(len(m)) if asked else np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", m, m), 0))
            m = np.concatenate([m, rest[:, None]], 1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def nearest(self, m: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of lifted rows, nearest first."""
        away = np.einsum("ij,ij->i", self.centres, self.centres) / 2 if self.metric == "l2" else 0
        return np.argsort(-(m @ self.centres.T - away), axis=1, kind="stable")[:, :n]

    @property
    def dim(self) -> int:
        return self.centres.shape[1] - (self.metric == "dot")


def fit_cells(vectors: DataFrame, cells: int | None = None, fit_rows: int = FIT_ROWS, rounds: int = 8, seed: int = 42, metric: str = "cosine") -> Cells:
    """An index's cells, by k-means on the `fit_rows` rows of least hashed ids. An index is of one
    dimension, the one that most vectors have; without vectors it has no cells."""
    metric = {"euclidean": "l2", "innerproduct": "dot"}.get(metric.lower(), metric.lower())
    metric = metric if metric in ("l2", "dot") else "cosine"
    whole = _whole(vectors)
    sizes = whole.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return Cells(np.zeros((0, 1)), metric)
    whole = whole.filter(F.size("vec") == sizes[0].dim)
    longest = whole.agg(F.max(expr.dot(F.col("vec"), F.col("vec")))).first()[0] ** 0.5 if metric == "dot" else 0.0
    rows = whole.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    index = Cells(np.zeros((0, 1)), metric, longest)
    sample = index.lifted(np.array([r.vec for r in rows], np.float64))
    n = min(cells or max(1, int(len(sample) ** 0.5 / 2)), len(sample), MAX_CELLS)
    index.centres = sample[np.random.default_rng(seed).choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        near = index.nearest(sample, 1)[:, 0]
        for c in range(n):
            mine = sample[near == c]
            if len(mine):
                index.centres[c] = mine.mean(0)
        if metric != "l2":
            index.centres /= np.maximum(np.linalg.norm(index.centres, axis=1, keepdims=True), 1e-12)
    return index


def assign(vectors: DataFrame, index: Cells, probes: int = 1, id_col: str = "id", asked: bool = False) -> DataFrame:
    """(id, vec, cell): each row of the index's dimension in its nearest `probes` cells."""
    shipped = prepare(vectors.sparkSession).sparkContext.broadcast(index)

    def run(batches):
        index = shipped.value
        for b in batches:
            near = index.nearest(index.lifted(_matrix(b.column(1), index.dim), asked), probes)
            rep = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rep), b.column(1).take(rep), pa.array(near.ravel().astype(np.int32))], names=[id_col, "vec", "cell"])

    fit = _whole(vectors).filter(F.size("vec") == index.dim)
    return fit.select(F.col(id_col).cast("bigint").alias(id_col), "vec").mapInArrow(run, f"{id_col} bigint, vec array<float>, cell int")


def search_cells(vectors: DataFrame, queries: DataFrame, k: int, index: Cells, probes: int = 8) -> DataFrame:
    """(qid, id, score, rank): approximate top-k by the index's metric over the `probes` nearest cells
    (the effort) of each query of the index's dimension. Every row of that dimension is
    indexed; cells beyond CELL_ROWS are split by id over tasks."""
    placed = assign(vectors, index)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("splits"))
    left = placed.join(F.broadcast(sizes), "cell").withColumn("split", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")).drop("splits")  # MAX_CELLS rows at most
    right = assign(queries, index, probes, "qid", True).join(F.broadcast(sizes.select(F.col("cell"), F.col("splits").alias("parts"))), "cell").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    metric = index.metric
    nearer = 1 if metric == "l2" else -1

    def match(key, mine, asked):
        if not mine.num_rows or not asked.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))
        v = np.array(mine.column("vec").to_pylist(), np.float64)
        q = np.array(asked.column("vec").to_pylist(), np.float64)
        ids, qids = mine.column("id").to_numpy(), asked.column("qid").to_numpy()
        s = scores(q, v, metric)
        at = [_best(nearer * x, ids, k) for x in s]
        return pa.Table.from_batches([_rows(np.repeat(qids, [len(a) for a in at]), np.concatenate([ids[a] for a in at]), np.concatenate([x[a] for x, a in zip(s, at)]))])

    got = left.groupBy("cell", "split").cogroup(right.groupBy("cell", "split")).applyInArrow(match, _FOUND)
    return top(got, ["qid"], [(F.col("score") * nearer).asc(), F.asc("id")], k, "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours that were found."""
    hit = exact.join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
