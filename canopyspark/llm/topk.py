"""Exact top-k search by inner product: a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_long, bounded, bounded_sample, column, map_batches, stage

#: Pivots are the farthest of each other among at most SAMPLE vectors, chosen by hash of their ids.
PIVOTS, SAMPLE = 32, 512
#: Distance rings of a pivot in the histogram, vectors a block, queries a chunk.
RINGS, BLOCK, CHUNK = 64, 2048, 512
#: Slack of floating-point distances, as a share of the largest norm.
SLACK = 1e-6


class Pivots:
    """Pivots for vectors lifted by one coordinate, sqrt(M^2 - |x|^2), so that all have norm M.

    For a query lifted by 0 the largest inner products are the smallest distances:
    d(q, x)^2 = |q|^2 + M^2 - 2 q.x, and distances obey the triangle inequality.
    """

    def __init__(self, sample: np.ndarray, most: float):
        self.most = most
        lifted = self.lift(sample)
        chosen = [0] if len(lifted) else []
        far = np.full(len(lifted), np.inf)
        while chosen and len(chosen) < PIVOTS:
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.points = lifted[chosen]

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.hstack([x, np.sqrt(np.maximum(self.most**2 - (x * x).sum(1), 0))[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted * lifted).sum(1)[:, None] + (self.points * self.points).sum(1)[None, :] - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self.distances(np.hstack([q.astype(float), np.zeros((len(q), 1))]))


def _matrix(column: object, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(-1, dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products (through doubles where no sum can pass 2^53)."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, one place an id (its best), ties to the smaller id."""
    take, n = k, len(scores)
    while True:
        whole = n <= 4 * take
        places = np.arange(n) if whole else np.flatnonzero(scores >= np.partition(scores, n - take)[n - take])
        places = places[np.lexsort((ids[places], -scores[places]))]
        first = np.sort(np.unique(ids[places], return_index=True)[1])
        if whole or len(first) >= k:
            return places[first[:k]]
        take *= 4


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its k highest integer inner products among all other rows.

    Components become floor(scale * x). Rows whose id or vector is null, whose vector holds null or non-finite
    components, is empty, or has another length than most vectors, take no part. Ties go to the smaller id; fewer than
    k other rows give as many. Rows of one id count as one, at its best score, and never find their own id.

    1. Each vector is keyed by its nearest pivot and its distance to it. A histogram of (pivot, ring of distances)
       gives blocks of about BLOCK vectors: rings are joined while they are small, and full ones are dealt over several
       blocks, so that copies of one vector fill no task.
    2. A block holds its vectors sorted by distance. Its own queries search it first: the score of their k-th id bounds
       what is still of use.
    3. Each query visits the annuli whose triangle-inequality bound lies within that; within a block the search expands
       from the query's own distance outwards and ends at the bound. Queries go in chunks, joined to blocks by number.
    4. The k best ids of all visited blocks, from the k best ids of each.

    What is collected is bounded: SAMPLE vectors, PIVOTS x RINGS counts.
    """
    spark = bounded(vectors.sparkSession)
    name, vector = column(key), column(vector)
    valid = name.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.where(F.coalesce(valid, F.lit(False)))
    common = sound.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score long"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common.d
    whole = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(scale)).cast("long"))
    rows = sound.where(F.size(vector) == dim).select(as_long(vectors, key).alias("id"), is_query.alias("q"), whole.alias("v"))

    most = float(np.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]))
    sample = bounded_sample(rows.select("v", F.xxhash64("id").alias("h")), SAMPLE).collect()
    pivots = Pivots(np.array([r.v for r in sample], np.int64), most)
    width = 2 * most / RINGS + 1e-9

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("v").flatten().to_numpy().reshape(-1, dim)
        d = pivots.distances(pivots.lift(x))
        cell = d.argmin(1)
        near = d[np.arange(len(x)), cell]
        raw = pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
        return pa.record_batch([batch.column("id"), batch.column("q"), pa.array(cell.astype(np.int32)), pa.array(np.minimum(near // width, RINGS - 1).astype(np.int32)), pa.array(near), raw], names=["id", "q", "cell", "ring", "near", "raw"])

    index = stage(map_batches(rows, keyed, "id long, q boolean, cell int, ring int, near double, raw binary"), "index")
    counts = index.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("lo"), F.max("near").alias("hi")).orderBy("cell", "ring").collect()
    annuli: list[list] = []  # cell, first ring, vectors, lo, hi
    for c in counts:
        if annuli and annuli[-1][0] == c.cell and annuli[-1][2] + c.n <= BLOCK:
            annuli[-1][2] += c.n
            annuli[-1][4] = c.hi
        else:
            annuli.append([c.cell, c.ring, c.n, c.lo, c.hi])
    parts = [-(-a[2] // BLOCK) for a in annuli]
    firsts = np.cumsum([0, *parts]).tolist()
    ring_of = {}
    at = -1
    for c in counts:
        if at + 1 < len(annuli) and annuli[at + 1][:2] == [c.cell, c.ring]:
            at += 1
        ring_of[c.cell, c.ring] = (firsts[at], parts[at])
    table = [(cell, ring, first, n) for (cell, ring), (first, n) in ring_of.items()]
    where = spark.createDataFrame(pd.DataFrame(table, columns=["cell", "ring", "first", "n"]).astype("int32"))
    cells, low, high = np.array([a[0] for a in annuli]), np.array([a[3] for a in annuli]), np.array([a[4] for a in annuli])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["near", "id"])
        x, ids = _matrix(pdf.raw, dim), pdf.id.to_numpy()
        places = np.flatnonzero(pdf.q.to_numpy())
        bounds = np.full(len(places), np.iinfo(np.int64).min)
        for i, p in enumerate(places):
            others = ids != ids[p]
            scores = products(x[p : p + 1], x)[0][others]
            found = best(scores, ids[others], k)
            if len(found) == k:
                bounds[i] = scores[found[-1]]
        return pd.DataFrame({"block": pdf.block.iloc[:1], "ids": [ids.tobytes()], "near": [pdf.near.to_numpy().tobytes()], "x": [x.tobytes()], "places": [places.astype(np.int64).tobytes()], "bounds": [bounds.tobytes()]})

    dealt = index.join(F.broadcast(where), ["cell", "ring"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id", "raw"), F.col("n"))).cast("int"))
    blocks = stage(dealt.select("block", "id", "q", "near", "raw").groupBy("block").applyInPandas(block, "block int, ids binary, near binary, x binary, places binary, bounds binary"), "blocks")

    def reach(q: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The distance within which a query's further results lie."""
        square = (q.astype(float) ** 2).sum(1) + most**2 - 2 * bounds.astype(float)
        return np.sqrt(np.maximum(square, 0)) + SLACK * (1 + most + np.sqrt((q.astype(float) ** 2).sum(1)))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                places = np.frombuffer(r["places"], np.int64)
                if not len(places):
                    continue
                q, ids, bounds = _matrix([r["x"]], dim)[places], np.frombuffer(r["ids"], np.int64)[places], np.frombuffer(r["bounds"], np.int64)
                far, d = reach(q, bounds), pivots.of_queries(q)[:, cells]
                open_ = np.maximum(d - high, low - d) <= far[:, None]
                for a in np.flatnonzero(open_.any(0)):
                    own = np.flatnonzero(open_[:, a])
                    for i in range(0, len(own), CHUNK):
                        o = own[i : i + CHUNK]
                        n = parts[a]
                        chunk = [ids[o].tobytes(), q[o].tobytes(), bounds[o].tobytes()]
                        columns = [pa.array(range(firsts[a], firsts[a] + n), pa.int32()), pa.array([int(cells[a])] * n, pa.int32()), *(pa.array([c] * n, pa.binary()) for c in chunk)]
                        yield pa.record_batch(columns, names=["block", "cell", "qids", "q", "bounds"])

    chunks = blocks.select("x", "ids", "places", "bounds").mapInArrow(visits, "block int, cell int, qids binary, q binary, bounds binary")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, qids, bounds = _matrix([r["q"]], dim), np.frombuffer(r["qids"], np.int64), np.frombuffer(r["bounds"], np.int64)
                x, ids, near = _matrix([r["x"]], dim), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["near"])
                d, far = pivots.of_queries(q)[:, r["cell"]], reach(q, bounds)
                # Sorted by distance: the open annulus around the query is one slice.
                start, stop = np.searchsorted(near, d - far), np.searchsorted(near, d + far, "right")
                lo, hi = int(start.min()), int(stop.max())
                scores = products(q, x[lo:hi])
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for i in range(len(q)):
                    s, e = start[i] - lo, stop[i] - lo
                    if s >= e:
                        continue
                    own, row = ids[start[i] : stop[i]], scores[i, s:e]
                    use = np.flatnonzero((row >= bounds[i]) & (own != qids[i]))
                    if len(use):
                        use = use[best(row[use], own[use], k)]
                        found.append((np.full(len(use), qids[i]), own[use], row[use]))
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    hits = blocks.select("block", "ids", "near", "x").join(chunks, "block").select("cell", "qids", "q", "bounds", "ids", "near", "x").mapInArrow(searched, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_pivot_topk``: the 5 nearest of every vector whose id 50 divides, among all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: DuckDB's own version of :func:`query`, by brute force.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
