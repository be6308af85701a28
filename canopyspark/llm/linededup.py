"""Lines that many documents share: levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, drop_files, free_stem, join_hot, map_batches, new_path, quoted, schema_text, stage, texts_of, without

#: Batches at least, and documents in one at most.
BATCHES, BATCH_DOCS = 4, 1 << 28


def line_keys(text: str) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and the key of each: stripped of ASCII white space, A-Z lower-cased."""
    lines = text.encode("utf-8").split(b"\n")
    return lines, [x.strip().lower() for x in lines]


class LineRuns:
    """How many documents hold each line key, as levelled sorted runs in the shared folder.

    A run is a table bucketed and sorted by key, all runs in the same buckets, so that what meets by key lies together
    already: batches are joined with runs, and runs are merged, bucket by bucket, and no run is shuffled again.

    ``add`` takes a batch of ``(key binary)`` rows, one per document and key. It merge-anti-joins the batch with the runs of
    settled keys (those known to reach ``min_docs``; they need no more counting) and writes the rest as a sorted run at
    level 0. ``fanout`` runs of a level merge into one run of the next level; keys that reach ``min_docs`` then move to the
    settled runs, which are merged, too, when they are more than ``fanout``. ``settled`` merges what is left and returns the
    keys that reach it with their numbers of documents, as far as these were counted. ``close`` ends the use of the runs.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[DataFrame]] = {}
        self.done: list[DataFrame] = []
        self.tables: dict[DataFrame, str] = {}
        self.spare: list[DataFrame] = []

    def _run(self, df: DataFrame) -> DataFrame:
        name = f"canopy_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", new_path(self.spark, "run")).saveAsTable(name, format="parquet")
        run = self.spark.table(name)
        self.tables[run] = name
        return run

    def _drop(self, runs: list[DataFrame]) -> None:
        for run in runs:
            files = run.inputFiles()
            self.spark.sql(f"DROP TABLE {self.tables.pop(run)}")
            drop_files(self.spark, files)

    def _both(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """Two runs merged: a full outer join, for which neither is shuffled (an aggregate over their union would not see
        that equal keys lie together)."""
        n = F.coalesce(one["n"], F.lit(0)) + F.coalesce(other["n"], F.lit(0))
        return one.join(other, one["key"] == other["key"], "full_outer").select(F.coalesce(one["key"], other["key"]).alias("key"), n.alias("n"))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The sums of runs, two at a time; sums before the last are runs of their own, dropped with the next merge."""
        sums = runs[0]
        for i, run in enumerate(runs[1:], 2):
            sums = self._both(sums, run)
            if i < len(runs):
                sums = self._run(sums)
                self.spare.append(sums)
        return sums

    def add(self, keys: DataFrame) -> None:
        counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))  # summed in each task first: a line of every document stays small
        for run in self.done:
            counts = counts.join(run.select("key"), "key", "left_anti")
        self.levels.setdefault(0, []).append(self._run(counts))
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self._merge([level], level + 1)
            level += 1

    def _merge(self, levels: list[int], to: int) -> None:
        """Merge all runs of the levels; a key is in the merged run or, from ``min_docs`` on, in a settled one."""
        old = [run for level in levels for run in self.levels.pop(level, [])]
        sums = self._merged(old)
        self.levels.setdefault(to, []).append(self._run(sums.where(F.col("n") < self.min_docs)))
        self.done.append(self._run(sums.where(F.col("n") >= self.min_docs)))
        if len(self.done) > self.fanout:
            settled, self.done = self.done, []
            self.done = [self._run(self._merged(settled))]
            old += settled
        self._drop(old + self.spare)
        self.spare = []

    def settled(self) -> DataFrame:
        """``key, n``: keys of at least ``min_docs`` documents, each once."""
        if sum(map(len, self.levels.values())) > 1 or self.levels.get(0):
            self._merge(sorted(self.levels), 1 + max(self.levels))
        return reduce(DataFrame.unionByName, self.done) if self.done else self.spark.createDataFrame([], "key binary, n long")

    def close(self) -> None:
        self._drop(list(self.tables))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", fanout: int = 2) -> DataFrame:
    """Drop the lines that at least ``min_docs`` documents share, in every document.

    Each row is a document. A line's key is the line stripped of ASCII white space at both ends with A-Z in lower
    case; keys under ``min_chars`` code points are never dropped. A null or empty text is one empty line and stays.
    Returns all columns of ``docs`` with ``text`` rebuilt from the lines that stay (in order, joined by ``\\n``; "" where
    nothing stays), and the columns ``n_lines`` and ``n_dropped`` (these replace columns of the same names, whatever their
    case). Repeated rows count as documents of their own. An empty table gives an empty table.

    Scale: only 16-byte line hashes are shuffled for counting (pre-summed by key, so a line of every document costs
    one row a task); texts move once, to meet the hashes of their own frequent lines. Documents meet them by the text's
    hash; texts that very many documents have meet theirs by broadcast and are not dealt to one task, and texts without a
    frequent line meet nothing. Batches follow the rows: BATCHES, or as many as keep one under BATCH_DOCS documents.
    """
    spark = docs.sparkSession
    batches = max(BATCHES, -(-docs.count() // BATCH_DOCS))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in texts_of(batch.column("text")):
            keys = {k for k in line_keys(x)[1] if k and (min_chars <= 1 or len(k.decode("utf-8")) >= min_chars)}
            out.append([xxhash.xxh3_128_digest(k) for k in keys])
        return pa.record_batch([batch.column("of"), batch.column("batch"), pa.array(out, pa.list_(pa.binary()))], names=["of", "batch", "keys"])

    body = F.coalesce(column(text), F.lit(""))
    source = docs.select(body.alias("text"), F.xxhash64(body).alias("of"), F.pmod(F.xxhash64(F.lit(3), body, F.monotonically_increasing_id()), F.lit(batches)).cast("int").alias("batch"))
    lines = stage(map_batches(source, hashed, "of long, batch int, keys array<binary>"), "lines", "batch")
    runs = LineRuns(spark, min_docs, fanout)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).select(F.explode("keys").alias("key")))
    settled = stage(runs.settled(), "settled")
    runs.close()
    # A line of very many documents meets its rows by broadcast and not in one task.
    found = join_hot(lines.select("of", F.explode("keys").alias("key")), settled, ["key"], "n").where(F.col("n").isNotNull()).drop("n")
    # Each text once, with the hashes of its frequent lines (at most as many as it has lines) and how often it occurs.
    often = found.groupBy("of").agg(F.collect_set("key").alias("found"))
    hits = stage(lines.groupBy("of").agg(F.count(F.lit(1)).alias("times")).join(often, "of"), "hits")

    keep, stem = without(docs, "n_lines", "n_dropped"), free_stem(docs)
    schema = schema_text(docs.select(*quoted(keep))) + ", n_lines long, n_dropped long"

    def rebuilt(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, totals, drops = [], [], []
        for x, hit in zip(texts_of(batch.column(text)), batch.column(stem + "hits").to_pylist(), strict=True):
            if hit is None:
                made.append(x)
                totals.append(x.count("\n") + 1)
                drops.append(0)
                continue
            gone = set(hit)
            lines, keys = line_keys(x)
            kept = [line for line, key in zip(lines, keys, strict=True) if not key or xxhash.xxh3_128_digest(key) not in gone]
            made.append(b"\n".join(kept).decode("utf-8"))
            totals.append(len(lines))
            drops.append(len(lines) - len(kept))
        columns = [pa.array(made, pa.string()) if c == text else batch.column(c) for c in keep]
        return pa.record_batch([*columns, pa.array(totals, pa.int64()), pa.array(drops, pa.int64())], names=[*keep, "n_lines", "n_dropped"])

    rows = docs.select(*quoted(keep), F.when(body != "", F.xxhash64(body)).alias(stem + "of"))
    hits = hits.select(F.col("of").alias(stem + "of"), F.col("found").alias(stem + "hits"), F.col("times").alias(stem + "times"))
    joined = join_hot(rows, hits, [stem + "of"], stem + "times", 24 * F.size(stem + "hits"), merge=True).select(*quoted(keep), stem + "hits")
    return map_batches(joined, rebuilt, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_line_dedup``: lines of at least 10 documents leave every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: DuckDB's own version of :func:`query`.
ORACLE = r"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), flat AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM flat
), often AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT r, doc_id, line, i, k IN (SELECT k FROM often) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
