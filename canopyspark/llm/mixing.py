"""Mixing sources to target weights: hash-threshold histograms, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_KEYS, column, free_stem, quoted, stage, without, word_count

WEIGHTS = (3, 1, 2)
#: Hash bits: ``LEVELS`` digits of ``DIGIT`` bits.
DIGIT, LEVELS = 12, 5


def hash60(*parts: Column) -> Column:
    """60 bits of an md5 as a long, the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size)`` -> the same and ``target``.

    The budget is ``share`` of all sizes. It is dealt by weight (repeating over the sources by code point, null last);
    no source gets more than ``most`` times its size, and what is above goes to the others by weight until none is.
    Closed form: sources are capped in the order of cap by weight; the level that the others reach by weight is the
    largest of (budget left) / (weight left) along that order. One row a source: windows over it stay small.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    digit = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (digit + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_cap), F.lit(0.0))
    levels = weighed.withColumn("level", left / weight_left)
    return levels.withColumn("level", F.max("level").over(every)).select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 5, text: str = "text", source: str = "source", key: str = "doc_id", returned: list[str] | None = None) -> DataFrame:
    """How many words of each document a mix takes, so that each source comes near its target.

    A source whose target is c times its size and a rest takes every document c times, and once more those whose
    hash lies under a threshold. The threshold comes from histograms: sizes are summed by source and leading hash
    digit, the digit in which the running sum passes the rest is the boundary bucket, and only that bucket is summed
    again by its next digit, until it holds one document. That document is taken where this comes nearer to the
    target. Thresholds of smaller budgets lie below those of larger ones, so the mixes are nested. Nothing is sorted.

    The hash takes key, source and text: reruns agree, whatever the partitions. Rows equal in all three share a hash and
    can't be told apart; if the threshold falls among them, as many of them are taken as come nearest to the target.
    A null text has size 0 and takes 0; a null source is a source; an empty table gives an empty table.
    Returns the columns of ``docs`` (or those in ``returned``) and ``size``, ``source_size``, ``target``, ``taken``
    (replacing columns of these names, whatever their case), ``taken`` = size times the number of times that the document
    is taken. Words are counted once where ``returned`` leaves the text out, else again for the result.
    """
    stem, own = free_stem(docs), [c for c in without(docs, "size", "source_size", "target", "taken") if returned is None or c in returned]
    size, h, of = (stem + x for x in ("size", "h", "of"))
    hashed = hash60(F.lit(str(seed)), F.coalesce(column(key).cast("string"), F.lit("")), F.coalesce(column(source), F.lit("\x00")), F.md5(F.coalesce(column(text), F.lit("")).cast("binary")))
    inner = [column(source).alias(of), word_count(column(text)).alias(size), hashed.alias(h)]
    if text in own:
        full = docs.select(*quoted(own), *inner)
        slim = stage(docs.select(*inner), "sizes")
    else:
        full = slim = stage(docs.select(*quoted(own), *inner), "sizes")
    cuts = thresholds(slim.select(F.col(of).alias("source"), F.col(size).alias("size"), F.col(h).alias("_h")), share, most)
    kept = [F.col(c).alias(stem + c) for c in cuts.columns]
    few = cuts.limit(HOT_KEYS + 1).count() <= HOT_KEYS
    cut = cuts.select(*kept)
    cut = F.broadcast(cut) if few else cut
    met = full.join(cut, F.col(of).eqNullSafe(F.col(stem + "source")))
    tied = F.col(h) == F.col(stem + "tie")
    below = F.when(F.col(h) < F.col(stem + "cut"), 1).otherwise(0)
    if cuts.where("tie IS NOT NULL").head(1):
        # Equal rows at the boundary: numbered part by part, the first ``more`` of them are taken.
        part, place, start = (stem + x for x in ("part", "place", "start"))
        equal = stage(met.where(tied).withColumn(part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(256))), "tied")
        before = W.partitionBy(of).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
        starts = equal.groupBy(of, part).agg(F.count(F.lit(1)).alias(place)).select(F.col(of).alias(stem + "o"), F.col(part).alias(stem + "p"), F.coalesce(F.sum(place).over(before), F.lit(0)).alias(start))
        equal = equal.withColumn(place, F.row_number().over(W.partitionBy(of, part).orderBy(h)))
        equal = equal.join(starts, F.col(of).eqNullSafe(F.col(stem + "o")) & (F.col(part) == F.col(stem + "p")))
        equal = equal.withColumn(stem + "once", F.when(F.col(start) + F.col(place) <= F.col(stem + "more"), 1).otherwise(0))
        rest = met.where(~F.coalesce(tied, F.lit(False))).withColumn(stem + "once", below)
        met = rest.unionByName(equal.select(*quoted(rest.columns)))
    else:
        met = met.withColumn(stem + "once", below)
    times = F.col(stem + "c") + F.col(stem + "once")
    return met.select(*quoted(own), F.col(size).alias("size"), F.col(stem + "source_size").alias("source_size"), F.col(stem + "target").alias("target"), (F.col(size) * times).alias("taken"))


def thresholds(slim: DataFrame, share: float, most: float) -> DataFrame:
    """``(source, size, _h)`` of all documents -> per source its size and target, full takes ``c`` and hash cut ``cut``;
    where equal rows lie at the cut, their hash ``tie`` and how ``more`` of them are taken."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long")
    state = targets.withColumn("c", whole).withColumn("_rest", F.greatest(F.col("target") - F.col("c") * F.col("source_size"), F.lit(0.0)))
    none = F.lit(None).cast("long")
    state = stage(state.withColumns({"cut": F.lit(0).cast("long"), "_open": F.col("_rest") > 0, "tie": none, "more": none}), "state")
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        inside = slim.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_h"))
        opened = state.where("_open").select("source", "cut", "_rest")
        at = F.shiftright("_h", shift + DIGIT) == F.shiftright("cut", shift + DIGIT)
        digit = F.shiftright("_h", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        sums = inside.join(F.broadcast(opened) if opened.limit(HOT_KEYS + 1).count() <= HOT_KEYS else opened, F.col("_s").eqNullSafe(F.col("source")) & at).groupBy("source", "_rest", digit.alias("_d")).agg(F.sum("_z").alias("_z"), F.count(F.lit(1)).alias("_n"))
        run = W.partitionBy("source").orderBy("_d")
        summed = sums.withColumn("_to", F.sum("_z").over(run)).where(F.col("_to") >= F.col("_rest")).groupBy(F.col("source").alias("_s")).agg(F.min(F.struct("_d", "_to", "_z", "_n")).alias("b"))
        joined = state.join(summed, F.col("source").eqNullSafe(F.col("_s")) & F.col("_open"), "left")
        below = F.col("b._to") - F.col("b._z")
        last = (F.col("b._n") == 1) | F.lit(level == LEVELS - 1)
        nearer = F.col("b._to") - F.col("_rest") < F.col("_rest") - below
        start = F.col("cut") + F.shiftleft(F.col("b._d"), shift)
        # At the end more than one row are equal ones: the sum of the first of them that comes nearest to the rest.
        equal = last & (F.col("b._n") > 1) & (F.col("b._z") > 0)
        units = (F.col("_rest") - below) / (F.col("b._z") / F.col("b._n"))
        state = stage(
            joined.select(
                "source", "source_size", "target", "c",
                F.when(F.col("b").isNull(), F.col("_rest")).otherwise(F.col("_rest") - below).alias("_rest"),
                F.when(F.col("b").isNull(), F.when(F.col("_open"), F.lit(1 << 60)).otherwise(F.col("cut"))).when(last & nearer & ~equal, start + F.lit(1 << shift)).otherwise(start).alias("cut"),
                F.coalesce(F.col("_open") & F.col("b").isNotNull() & ~last, F.lit(False)).alias("_open"),
                F.when(F.col("_open") & equal, start).otherwise(F.col("tie")).alias("tie"),
                F.when(F.col("_open") & equal, F.ceil(units - 0.5)).otherwise(F.col("more")).cast("long").alias("more"),
            ),
            "state",
        )
        if not state.where("_open").head(1):
            break
    return state.select("source", "source_size", "target", "c", "cut", "tie", "more")


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken (``taken / size`` rows); those of size 0 or taken 0 times have none.

    Repeated rows are each taken as they say. A column ``copy`` is replaced by which of the times a row stands for.
    """
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    own = without(mixed, "copy")
    return mixed.where(times >= 1).select(*quoted(own), F.explode(F.sequence(F.lit(1), times)).alias("copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_mix_sources``: 150 % of all words, weights 3, 1, 2, no source above twice its words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs, returned=["doc_id"])


#: DuckDB's own version of :func:`query`: the same hash, but a sort instead of histograms.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('5|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, chr(0)) || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), t AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), u AS (
  SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM t
), v AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS c FROM u
), x AS (
  SELECT d.*, source_size, target, c, greatest(target - c * source_size, 0) AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source
)
SELECT doc_id, size, source_size, target,
       (size * (c + CASE WHEN rest <= 0 THEN 0 WHEN upto < rest THEN 1
                         WHEN upto - size >= rest THEN 0
                         WHEN upto - rest < rest - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
