"""Document fingerprints from closed syncmers, in DataFrame operations alone."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, free_stem, quoted, without

#: Letters of the alphabet are words of up to 16 code points, and the single code points of longer runs, so that letters of
#: texts without white space don't depend on where a run begins either.
LETTER = r"((?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D])"
#: k-mers of 5 letters whose least 2-mer is the first or the last of its four.
K, S = 5, 2
#: Hashes kept in a fingerprint: the least ones, 32 bits each.
SKETCH = 64
#: Documents a block of neighbours, and blocks at most.
BLOCK_ROWS, MOST_BLOCKS, FAN = 512, 1 << 16, 256


def with_syncmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the hashes of a text's closed syncmers in order, null where a k-mer isn't one.

    Element i belongs to the k-mer that starts at letter i, so hashes keep their positions. Whether a k-mer is taken
    depends on its own letters alone, so a passage has the same anchors wherever it stands. One without any (it is
    short) has the hash of its whole sequence; a null, an empty text or one without letters has none. Equal texts have
    equal syncmers; an empty table stays empty. A column ``out`` is replaced, whatever its case; no other name clashes.
    """
    own, stem = without(df, out.lower()), free_stem(df)
    letters, h, p, a = (stem + x for x in "lhpa")
    df = df.select(*quoted([*own, *([text] if text not in own else [])]), F.regexp_extract_all(F.coalesce(column(text), F.lit("")), F.lit(LETTER), F.lit(1)).alias(letters))
    df = df.withColumn(h, F.transform(letters, lambda x: F.xxhash64(x)))
    df = df.withColumn(p, F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1))))
    last = F.size(h) - K

    def anchor(i: Column) -> Column:
        edge = F.least(F.get(p, i), F.get(p, i + K - S))
        inner = F.least(*[F.get(p, i + j) for j in range(1, K - S)])
        return F.when(edge <= inner, F.xxhash64(F.get(p, i), F.get(h, i + S), F.get(p, i + K - S)))

    df = df.withColumn(a, F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), anchor)))
    whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    some = F.exists(a, lambda x: x.isNotNull())
    return df.select(*quoted(own), F.when(F.coalesce(some, F.lit(False)), F.col(a)).otherwise(whole).alias(out))


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the sorted least SKETCH distinct hashes (32 bits) of a text's syncmers; of a null or empty text none.

    Equal texts have equal sketches; an empty table stays empty. A column ``out`` is replaced, whatever its case.
    """
    own, y = without(df, out.lower()), free_stem(df) + "y"
    hashes = F.array_distinct(F.transform(F.filter(y, lambda x: x.isNotNull()), lambda x: F.shiftrightunsigned(x, 32)))
    return with_syncmers(df, text, y).select(*quoted(own), F.slice(F.sort_array(hashes), 1, SKETCH).alias(out))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: 8 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches: common hashes among the least of their union; 1 if both are empty."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union)).cast("double")


def _block(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most ``value``, found in two steps."""
    coarse = F.from_json(F.lit(str(bounds[FAN - 1 :: FAN])), "array<bigint>")
    fine = F.from_json(F.lit(str(bounds)), "array<bigint>")
    skip = F.size(F.filter(coarse, lambda b: b <= value)) * FAN
    return skip + F.size(F.filter(F.slice(fine, skip + 1, FAN), lambda b: b <= value))


def with_next(docs: DataFrame, key: str, columns: list[str], made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``next_<column>`` for each of ``columns``: its value in the next row by ascending key; the last row gets the first's.

    Null keys come first; rows of equal keys are ordered by a hash of ``columns``, equal rows can't be told apart. A row
    alone is its own next; an empty table stays empty. Columns ``next_<column>`` are replaced, whatever their case.

    ``made`` adds columns that follow from a row (such as a sketch); they come with their ``next_`` too, and are made once
    a row and again for the first row of a block only.

    Rows are dealt to ranges of the key that hold about BLOCK_ROWS rows each (quantiles of it, MOST_BLOCKS at most) and
    move once; a key that fills several quantiles, and null keys, are dealt further by the hash. Within a range the next
    row is a window's; the last row of a range gets the first row of the next range from a table of one row a range.
    """
    stem = free_stem(docs)
    b, t, end, was, frm, k = (stem + x for x in ("b", "t", "end", "was", "from", "k"))
    base = docs.select(*quoted(without(docs, *[f"next_{c}".lower() for c in columns])))
    n, nulls = docs.agg(F.count(F.lit(1)), F.count_if(column(key).isNull())).first()
    want = max(1, min(MOST_BLOCKS, math.ceil(n / BLOCK_ROWS)))
    cuts = [i / want for i in range(1, want)]
    found = sorted(docs.agg(F.percentile_approx(column(key), cuts, 10 * max(want, 1000)).alias("q")).first().q or []) if cuts else []
    tie = F.xxhash64(*quoted(columns))
    among = lambda count: F.floor(F.shiftrightunsigned(F.xxhash64(F.lit(7), tie), 33) * count / F.lit(float(1 << 31))).cast("int")
    block = _block(found, column(key)) if found else F.lit(0)
    if heavy := {x: m for x, m in Counter(found).items() if m > 1}:  # quantiles that are one key
        times = F.try_element_at(F.from_json(F.lit(json.dumps(heavy)), "map<string,int>"), column(key).cast("string"))
        block = F.when(times.isNotNull(), block - times + 1 + among(times)).otherwise(block)
    apart = max(1, math.ceil(nulls / BLOCK_ROWS))
    block = F.when(column(key).isNull(), among(F.lit(apart)) - apart).otherwise(block).cast("int")
    raw = base.withColumns({b: block, t: tie})
    rows = made(raw) if made else raw
    linked_columns = [*columns, *(c for c in rows.columns if c not in raw.columns)]
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(t)), 33)
    order = W.partitionBy(b).orderBy(column(key).asc_nulls_first(), spread, t)
    linked = rows.select("*", *[F.lead(column(c)).over(order).alias(f"{stem}n_{c}") for c in linked_columns], F.lead(F.lit(True)).over(order).isNull().alias(end))
    # min of a struct orders by key, then hashes; a block holds null keys only or none.
    head = F.struct(column(key).alias("k"), spread.alias("s"), F.col(t).alias("t"))
    heads = raw.select(b, head.alias("f")).groupBy(b).agg(F.min("f").alias("f"))
    along = W.orderBy(b)
    follow = heads.select(F.col("f.k").alias(k), F.col("f.t").alias(stem + "ft"), F.coalesce(F.lag(b).over(along), F.last(b).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias(frm))
    first = raw.join(F.broadcast(follow), column(key).eqNullSafe(F.col(k)) & (F.col(t) == F.col(stem + "ft"))).dropDuplicates([frm])
    first = made(first) if made else first
    first = first.select(frm, F.lit(True).alias(was), *[column(c).alias(f"{stem}f_{c}") for c in linked_columns])
    joined = linked.join(first, (F.col(b) == F.col(frm)) & F.col(end) & F.col(was), "left")
    made_columns = linked_columns[len(columns):]
    return joined.select(*quoted([*base.columns, *made_columns]), *[F.when(F.col(end), F.col(f"`{stem}f_{c}`")).otherwise(F.col(f"`{stem}n_{c}`")).alias(f"next_{c}") for c in linked_columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_syncmer_fingerprints``: each document's fingerprint, that of its edited text, and how alike they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    linked = with_next(docs, "doc_id", ["text"], lambda rows: with_sketch(rows, "text", "sketch"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = linked.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    edited = with_sketch(edited.drop("text", "next_text"), "edited", "edited_sketch")
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
