"""Shards in random order: an external shuffle in two passes, in DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_KEYS, column, free_stem, join_hot, quoted, running_starts, stage, without

#: Bytes that each row counts for besides its text.
ROW_BYTES = 8


#: Buckets at least, so that small tables are dealt to many tasks, and partitions that hold them at most.
FEWEST, PARTS = 32, 16_384


def shuffle_into_shards(df: DataFrame, n_shards: int = 24, seed: int = 17, bucket_bytes: int = 8 << 20, text: str = "text") -> DataFrame:
    """Deal all rows of ``df`` out to ``n_shards`` shards in random order; shard sizes differ by one row at most.

    Pass 1 scatters the records by a seeded hash into buckets of about ``bucket_bytes`` each; their number follows from
    the size of all rows. Pass 2 shuffles each bucket in memory (``shuffle`` is Fisher-Yates, its stream is seeded by the
    bucket's place) and writes it. The position of a row in the sequence of buckets, p, gives shard p mod n_shards and
    slot p div n_shards.

    Returns the columns of ``df`` with ``size`` (UTF-8 bytes of the text, null counting none, plus 8), ``shard`` and
    ``slot`` (from 0, without gaps); these replace columns of the same names, whatever their case. The hash takes the
    whole row, and of equal rows their number among each other, so that copies scatter like others. The result follows
    from the rows and not from how they lie in files and partitions; equal rows can't be told apart. An empty table gives
    an empty table.

    Scale: each record moves once. A partition holds whole buckets and its number is theirs modulo PARTS, so a task reads
    one bucket while there are no more than PARTS of them, and for tables beyond that ``bucket_bytes`` can follow the
    executors' memory. Counts of equal rows and offsets move a few bytes a row or bucket; a third of all rows may be equal.
    """
    own = without(df, "size", "shard", "slot")
    stem = free_stem(df)
    bucket, part, at, start, copy, row_id, h = (stem + x for x in ("bucket", "part", "at", "start", "copy", "id", "h"))
    size = F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long") + F.lit(ROW_BYTES)
    rows = df.select(*quoted(own))
    row = F.struct(*quoted(own))
    slim = rows.select(F.xxhash64(F.lit(seed), row).alias("h"), size.alias("z"))
    counts = slim.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("z"))
    total, most = counts.agg(F.sum("z"), F.max("n")).first()
    buckets = max(FEWEST, math.ceil((total or 0) / bucket_bytes))
    hashed = rows.withColumn(h, F.xxhash64(F.lit(seed), row))
    if (most or 0) > 1:
        hashed = hashed.withColumn(row_id, F.monotonically_increasing_id())
        numbered = _numbered(hashed.select(F.col(h).alias("h"), F.col(row_id).alias("id")), counts).select(F.col("h").alias(h), F.col("id").alias(row_id), F.col("copy").alias(copy))
        few = numbered.limit(HOT_KEYS + 1).count() <= HOT_KEYS
        hashed = hashed.join(F.broadcast(numbered) if few else numbered, [h, row_id], "left")
    number = F.coalesce(F.col(copy), F.lit(0)) if copy in hashed.columns else F.lit(0)
    mixed = F.xxhash64(F.lit(seed + 1), F.col(h), number.cast("long"))
    parts = min(buckets, PARTS)
    scattered = hashed.select(F.pmod(mixed, F.lit(buckets)).cast("int").alias(bucket), F.struct(mixed.alias("h"), size.alias("size"), row.alias("row")).alias("r"))
    dealt = scattered.withColumn(part, F.pmod(F.col(bucket), F.lit(parts)).cast("int")).repartitionById(parts, F.col(part))
    filled = dealt.groupBy(part, bucket).agg(F.sort_array(F.collect_list("r")).alias("rs")).sortWithinPartitions(bucket)
    shuffled = filled.select(bucket, F.posexplode(F.shuffle("rs", seed)).alias(at, stem + "r"))
    written = stage(shuffled.select(bucket, at, F.col(f"{stem}r.size").alias(stem + "size"), *[F.col(f"{stem}r.row")[c].alias(c) for c in own]), "buckets")
    starts = running_starts(written.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), bucket, "n", start)
    place = F.col(start) + F.col(at)
    # One row a bucket: broadcast while their number, known here, is small.
    return written.join(F.broadcast(starts) if buckets <= HOT_KEYS else starts, bucket).select(
        *quoted(own), F.col(stem + "size").alias("size"), (place % n_shards).cast("int").alias("shard"), F.floor(place / F.lit(n_shards)).cast("long").alias("slot"),
    )


def _numbered(rows: DataFrame, counts: DataFrame, parts: int = 64) -> DataFrame:
    """``h, id, copy``: the place of each row among those of its hash, from 0, for hashes of more than one row.

    Rows of a hash are dealt to ``parts`` by their id and numbered there, after the rows of earlier parts.
    """
    mine = stage(join_hot(rows, stage(counts.where("n > 1").select("h", "n"), "copies"), ["h"], "n").where(F.col("n").isNotNull()).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))), "copies")
    before = W.partitionBy("h").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = mine.groupBy("h", "part").agg(F.count(F.lit(1)).alias("m")).select("h", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    placed = mine.withColumn("i", F.row_number().over(W.partitionBy("h", "part").orderBy("id")) - 1)
    return stage(placed.join(starts, ["h", "part"]).select("h", "id", (F.col("start") + F.col("i")).alias("copy")), "copies")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder a shard, each file in slot order; a shard is one task and never larger than its share."""
    n = sharded.agg(F.max("shard")).first()[0]
    if n is None:
        sharded.write.parquet(path)
    else:
        sharded.repartition(n + 1, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_shards``: all documents in 24 shards under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return shuffle_into_shards(docs, 24).select("doc_id", "size", crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
