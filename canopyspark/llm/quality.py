"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, bounded_sample, map_batches, quoted, schema_text
from .words import Remembered, hashed_words, runs, scatter, word_hash

BITS = 20
#: Labelled rows that the classifier is fitted on at most, chosen by hash of doc_id.
TRAINING_ROWS = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.5, 0.1, 1e-3, 1e-3
CUT = 0.7


def _shape(word: bytes) -> int:
    """Hash of a word's shape: runs of upper-case letters, other letters, digits, and of each other sign, as one sign each."""
    out: list[str] = []
    for c in word.decode(errors="replace"):
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return xxhash.xxh64_intdigest("".join(out).encode(), 9)


word_shape = Remembered(_shape)
_TOP = np.uint64(64 - BITS)


def families(h: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of a text: 1- and 2-grams of its words and of their shapes, and whether a word repeats the last."""
    if not len(h):
        return []
    out = [scatter(h), scatter(s)]
    if len(h) > 1:
        same = np.where(h[1:] == h[:-1], np.uint64(77), np.uint64(78))
        out += [runs(h, 2), runs(s, 2), scatter(same)]
    return [(x >> _TOP).astype(np.int64) for x in out]


def sparse(h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text as a sparse vector, each feature once; each family of features sums to 1."""
    index, value = [np.empty(0, np.int64)], [np.empty(0)]
    for f in families(h, s):
        u, n = np.unique(f, return_counts=True)
        index.append(u)
        value.append(n / len(f))
    every, place = np.unique(np.concatenate(index), return_inverse=True)
    return every, np.bincount(place, np.concatenate(value), len(every))


@dataclass
class Weights:
    """Feature weights and bias; none of either if there was nothing to learn from."""

    bias: float
    weights: np.ndarray | None

    def score(self, texts: pa.Array) -> list[float]:
        if self.weights is None:
            return [1.0] * len(texts)
        z = [self.bias + sum(float(self.weights[f].mean()) for f in families(h, s)) for h, s in hashed_words(texts, False, word_hash, word_shape)]
        return (1 / (1 + np.exp(-np.clip(z, -35, 35)))).tolist()


class Ftrl:
    """FTRL-proximal with a rate of its own for each coordinate; the last coordinate is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def at(self, i: np.ndarray | slice) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def learn(self, i: np.ndarray, v: np.ndarray, y: float) -> None:
        w = self.at(i)
        g = (1 / (1 + np.exp(-np.clip(v @ w, -35, 35))) - y) * v
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, text: str = "text") -> Weights:
    """Learn ``label`` (0 or 1) of documents, from labelled rows that aren't held out.

    At most ``rows`` labels are used, chosen by hash of doc_id; a null label or id is none. Of rows that share an id and a
    label one counts, that of the least hash of its text; a null or empty text, or one without words, has the bias alone.
    Features are made on the executors; one task reads them as a sorted stream, once an epoch, so it holds a batch of them
    at a time, and the result is the same each time. Only the weights (4 MB) reach the driver. Without a label, as for
    empty tables, there are no weights and every score is 1. Other columns are not read.
    """
    spark = bounded(docs.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.select("doc_id", F.col(label).cast("double").alias("y"), F.xxhash64("doc_id").alias("h"))
    chosen = bounded_sample(chosen, rows)
    known = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "doc_id").select("h", "y", "text", F.xxhash64("text").alias("t"))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [sparse(h, s) for h, s in hashed_words(batch.column("text"), False, word_hash, word_shape)]
        return pa.record_batch([*(batch.column(c) for c in ("h", "y", "t")), pa.array([i.astype(np.int32) for i, _ in pairs], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in pairs], pa.list_(pa.float32()))], names=["h", "y", "t", "i", "v"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            for i, v, y in zip(b.column("i"), b.column("v"), b.column("y").to_pylist(), strict=True):
                model = model or Ftrl(1 << BITS)
                model.learn(np.append(i.values.to_numpy(), 1 << BITS), np.append(v.values.to_numpy(), np.float32(1)).astype(float), y)
        if model is None:
            return
        w = model.at(slice(None)).astype(np.float32)
        yield pa.record_batch([pa.array([w.tobytes()], pa.binary())], names=["w"])

    made = map_batches(known, features, "h long, y double, t long, i array<int>, v array<float>")
    one = made.groupBy("h", "y").agg(F.min_by(F.struct("i", "v"), F.coalesce("t", F.lit(0))).alias("x")).select("h", "y", "x.i", "x.v")
    epochs = one.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    found = epochs.repartition(1).sortWithinPartitions("epoch", "h", "y").select("i", "v", "y").mapInArrow(train, "w binary").collect()
    if not found:
        return Weights(0.0, None)
    w = np.frombuffer(bytes(found[0].w), np.float32)
    return Weights(float(w[-1]), w[:-1].copy())


def score(docs: DataFrame, weights: Weights, text: str = "text", out: str = "score", returned: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``returned``) and ``out``, a score from 0 to 1 of each whole text (null counts as empty).

    A narrow map; the weights (4 MB, fixed by BITS) are broadcast. Equal texts score alike; an empty text gets what
    the bias says. A column named ``out`` is replaced.
    """
    shared = bounded(docs.sparkSession).sparkContext.broadcast(weights)
    keep = [c for c in returned or docs.columns if c.lower() != out.lower()]
    schema = schema_text(docs.select(*quoted(keep))) + f", `{out}` double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.score(batch.column(text))
        return pa.record_batch([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, out])

    read = dict.fromkeys([*keep, text])
    return map_batches(docs.select(*quoted(list(read))), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_quality``: score every document by what ``labels.quality`` says of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, weights, returned=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
