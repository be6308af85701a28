"""What the operators of this folder share: tables in the shared folder, Arrow helpers, words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder, ship

#: ASCII white space, as ``bytes.split`` and ``bytes.strip`` take it.
SPACE = " \t\n\x0b\x0c\r"
#: Rows in an Arrow batch: the default of 10,000 whole texts can be hundreds of MB, once in the JVM and twice in Python.
BATCH_ROWS = 512
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/canopy-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, name: str, partition_by: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and a lost executor costs nothing before it.

    ``batch_rows``: rows in an Arrow batch of this write, where they are large.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if batch_rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove the files that a staged table read from (it must not be used any more)."""
    drop_files(df.sparkSession, df.inputFiles())


def drop_files(spark: SparkSession, files: list[str]) -> None:
    for top in {f.rsplit("/", 1)[0] for f in files if "/canopy-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession) -> SparkSession:
    """The session, its Python workers set up for texts: the package there, and small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship(spark)


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, most: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` over pieces of about ``most`` bytes (or one row): small batches go together, large ones are cut."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in pieces(batches, most):
                out = kernel(part.rename_columns(names))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
                del out
        finally:
            give_back()

    bounded(df.sparkSession)
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)  # names with dots can't be passed


def give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage, and what they keep counts for the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows and held and size + batch.nbytes > most:
            yield from slices(pa.concat_batches(held), most)
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield from slices(pa.concat_batches(held), most)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * most / max(1, batch.nbytes))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


#: Rows of one key that make it hot in a join; hot keys that are met by broadcast at most, and their bytes; parts that the
#: rows of a hot key are dealt to whose value is too long for that.
HOT_ROWS, HOT_KEYS, HOT_BYTES, SALTS = 256, 100_000, 32 << 20, 64


def free_stem(*tables: DataFrame) -> str:
    """A start of names that no column of the tables begins with, in any case; with a letter more it names inner columns."""
    names = [c.lower() for df in tables for c in df.columns]
    stem = "_"
    while any(n.startswith(stem) for n in names):
        stem += "_"
    return stem


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def column(name: str) -> Column:
    return quoted([name])[0]


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those of these names, whatever their case."""
    return [c for c in df.columns if c.lower() not in names]


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def as_long(df: DataFrame, key: str) -> Column:
    """An integer key as a long; a key of another type would turn into nulls and raises instead."""
    kind = df.select(column(key)).schema[0].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"column {key!r} must hold integers, not {kind.simpleString()}")
    return column(key).cast("long")


def join_hot(rows: DataFrame, right: DataFrame, on: list[str], n: str, size: Column | None = None, merge: bool = False) -> DataFrame:
    """``rows`` left join ``right`` on ``on``, where a few keys can hold very many rows. ``right`` is staged and has each key
    once, in ``n`` how many rows have it, and by ``size`` the bytes of its value (without: few). A null key finds nothing.

    Of the keys of at least HOT_ROWS rows the HOT_KEYS most frequent are treated apart; any other has at most one row in
    HOT_KEYS. The values of those that lead, up to HOT_BYTES in all, go to the rows by broadcast; these rows, and those with
    a null key, then go to any partition and not to that of their key. The values of the rest of them are copied to SALTS
    parts, to which their rows are dealt. All others meet by key; with ``merge`` also where ``right`` is so small that Spark
    would send all of it to the rows, so that a run over few rows takes the way of one over many.
    """
    stem = free_stem(rows, right)
    hot, cold, alone, salt, wide = (stem + x for x in ("hot", "cold", "alone", "salt", "wide"))
    values = [c for c in right.columns if c not in on]
    first = right.where(F.col(n) >= HOT_ROWS).select(*on, F.col(n).alias(hot), (F.lit(64) if size is None else size + 64).alias(cold)).orderBy(F.desc(hot), *on).limit(HOT_KEYS)
    until = W.orderBy(F.desc(hot), *on).rowsBetween(W.unboundedPreceding, 0)  # over HOT_KEYS short rows
    marks = stage(first.select(*on, (F.sum(cold).over(until) > HOT_BYTES).alias(wide)), "marks")
    found = {r[0]: r[1] for r in marks.groupBy(wide).count().collect()}
    met, others, parts = rows, right, F.array(F.lit(0))
    apart = F.lit(False)
    for c in on:
        apart = apart | column(c).isNull()
    if False in found:
        light = F.broadcast(marks.where(~F.col(wide)).select(*on))
        met = met.join(F.broadcast(right.join(light, on, "left_semi").select(*on, F.struct(*values).alias(hot))), on, "left")
        apart = apart | F.col(hot).isNotNull()
        others = right.join(light, on, "left_anti")
    if True in found:
        dealt = F.broadcast(marks.where(wide))
        met, others = met.join(dealt, on, "left"), others.join(dealt, on, "left")
        parts = F.when(F.col(wide), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(parts)
        met = met.withColumn(salt, F.when(F.col(wide), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    else:
        met = met.withColumn(salt, F.lit(0))
    met = met.withColumn(alone, F.when(apart, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    others = others.select(*[F.col(c).alias(f"{stem}on_{c}") for c in on], F.lit(-1).cast("long").alias(stem + "flag"), F.struct(*values).alias(cold), F.explode(parts).alias(stem + "part"))
    same = (F.col(alone) == F.col(stem + "flag")) & (F.col(salt) == F.col(stem + "part"))
    for c in on:
        same = same & (column(c) == F.col(f"{stem}on_{c}"))
    value = (lambda v: F.coalesce(F.col(f"{hot}.{v}"), F.col(f"{cold}.{v}"))) if False in found else (lambda v: F.col(f"{cold}.{v}"))
    return met.join(others.hint("merge") if merge else others, same, "left").select(*quoted(rows.columns), *[value(v).alias(v) for v in values])


def running_starts(counts: DataFrame, key: str, n: str, out: str, block: int = 4096) -> DataFrame:
    """``key, out``: the sum of ``n`` over all smaller keys (numbers from 0), by blocks of keys, so that no task holds all."""
    blocks = counts.groupBy(F.floor(F.col(key) / block).alias("_block")).agg(F.sum(n).alias("_sum"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    rows = counts.withColumn("_block", F.floor(F.col(key) / block)).withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return rows.join(blocks, "_block").select(key, (F.col("_base") + F.col("_in")).cast("long").alias(out))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; a null text is empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def bounded_sample(df: DataFrame, rows: int, h: str = "h") -> DataFrame:
    """At most ``rows`` rows, those of the smallest hashes in ``h`` among an even share of all hashes.

    The share is chosen from the number of rows so that about twice as many lie in it; so what tasks send for the
    selection doesn't grow with their number.
    """
    share = max(1, df.count() // (2 * rows))
    return df.where(F.pmod(F.shiftrightunsigned(h, 16), F.lit(share)) == 0).orderBy(h).limit(rows)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else. ``lower`` does it unless another upper-case letter is there."""
    wide = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]")
    return F.when(wide, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
