"""Centered rolling means, and the choice of their width by cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points of a series up to which folds come from a constant: the days of two years.
LONGEST = 732


def fold_ids(n: int, folds: int = 5, seed: int = 42) -> np.ndarray:
    """Fold of each position: a seeded permutation cut into ``folds`` parts, the first n % folds one longer."""
    out = np.empty(n, np.int32)
    for f, part in enumerate(np.array_split(np.random.RandomState(seed).permutation(n), folds)):
        out[part] = f
    return out


@lru_cache(maxsize=8)
def _fold_text(longest: int, folds: int, seed: int) -> str:
    """The folds of all series lengths from 0 to ``longest`` as words; fold f is the sign chr(48 + f)."""
    return " ".join("".join(chr(48 + f) for f in fold_ids(n, folds, seed)) if n >= folds else "-" for n in range(longest + 1))


def fold_of(n: Column, place: Column, folds: int = 5, seed: int = 42, longest: int | None = None) -> Column:
    """Fold of the ``place``-th of ``n`` points (from 1): looked up in a constant, for over LONGEST points by :func:`fold_ids`.

    With ``longest`` no series is longer than that (an error is raised where one is), and all come from the constant.
    """
    known = F.get(F.split(F.lit(_fold_text(longest or LONGEST, folds, seed)), " "), n.cast("int"))
    beyond = F.lit(None).cast("string")
    if longest:
        beyond = F.raise_error(F.concat(F.lit(f"a series has more than {longest} points: "), n.cast("string"))).cast("string")
    found = F.ascii(F.substring(F.when(n <= (longest or LONGEST), known).otherwise(beyond), place.cast("int"), F.lit(1))) - 48
    if longest:
        return found

    @F.pandas_udf("int")
    def beyond_constant(lengths: pd.Series, places: pd.Series) -> pd.Series:
        out = np.zeros(len(lengths), np.int32)
        length, at = lengths.fillna(0).to_numpy(int), places.fillna(1).to_numpy(int) - 1
        for one in np.unique(length[length > LONGEST]):
            out[length == one] = _folds(int(one), folds, seed)[at[length == one]]
        return pd.Series(out)

    return F.when(n <= LONGEST, found).otherwise(beyond_constant(n.cast("int"), place.cast("int")))


@lru_cache(maxsize=64)
def _folds(n: int, folds: int, seed: int) -> np.ndarray:
    return fold_ids(n, folds, seed)


def rolling(value: Column, window: int, keys: list[str], order: str) -> Column:
    """Centered mean over ``window`` rows (fewer at the ends), nulls skipped and kept null."""
    half = window // 2
    return F.when(value.isNotNull(), F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)))


def rolling_mean(df: DataFrame, keys: list[str], value: str, window: int, order: str = "date", out: str = "smoothed") -> DataFrame:
    return df.withColumn(out, rolling(F.col(value), window, keys, order))


def window_limit(days: int) -> int:
    """Windows count rows: at most 21 of a daily product, 9 of others."""
    return 21 if days == 1 else 9


def _squares(rows: DataFrame, parts: list[str], candidates: list[int], folds: int, seed: int, order: str, longest: int | None) -> DataFrame:
    """Adds ``_n``, ``_fold`` and for each candidate ``_e<w>``, the squared error of the prediction from other folds, to series of ``_v``.

    Running sums and counts by fold, taken at both ends of a window, give what its other points add up to: a point costs
    the same at any width. Values are taken from their mean, which keeps the sums small. One sort of the parts.
    """
    by = W.partitionBy(*parts)
    line = by.orderBy(order)
    rows = rows.withColumns({"_n": F.count("_v").over(by).cast("int"), "_pos": F.row_number().over(line), "_c": F.col("_v") - F.avg("_v").over(by)})
    rows = rows.withColumn("_fold", F.when((F.col("_n") >= folds) & F.col("_v").isNotNull(), fold_of(F.col("_n"), F.col("_pos"), folds, seed, longest)))
    until = line.rowsBetween(W.unboundedPreceding, 0)
    mine = [F.col("_fold") == f for f in range(folds)]
    # One array of running values: by fold the sums, then the counts, then both of all folds.
    running = [F.sum(F.when(m, F.col("_c")).otherwise(0.0)).over(until) for m in mine] + [F.count_if(m).over(until).cast("double") for m in mine]
    rows = rows.withColumn("_run", F.array(*running, F.sum("_c").over(until), F.col("_pos").cast("double")))
    ends = {"_end": F.last("_run").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))}
    for w in candidates:
        ends |= {f"_hi{w}": F.lead("_run", w // 2).over(line), f"_lo{w}": F.lag("_run", w // 2 + 1).over(line)}
    rows = rows.withColumns(ends)

    def between(w: int, place: Column) -> Column:
        return F.coalesce(F.get(F.col(f"_hi{w}"), place), F.get("_end", place)) - F.coalesce(F.get(F.col(f"_lo{w}"), place), F.lit(0.0))

    fold = F.col("_fold")
    errors = {}
    for w in candidates:
        others = between(w, F.lit(2 * folds + 1)) - between(w, fold + folds)
        mean = (between(w, F.lit(2 * folds)) - between(w, fold)) / F.nullif(others, F.lit(0.0))
        errors[f"_e{w}"] = F.pow(F.col("_c") - mean, 2)
    return rows.withColumns(errors).drop("_pos", "_c", "_run", *ends)


def _best(candidates: list[int], folds: int, mean: Callable[[Column], Column]) -> Column:
    """``mse, i, w`` of the least mean over folds of their mean squares; null where no candidate has one."""
    each = F.array(*[F.array(*[mean(F.when(F.col("_fold") == f, F.col(f"_e{w}"))) for f in range(folds)]) for w in candidates])

    def scored(errors: Column, i: Column) -> Column:
        some = F.filter(errors, lambda e: e.isNotNull())
        total = F.aggregate(some, F.lit(0.0), lambda s, e: s + e)
        return F.struct((total / F.nullif(F.size(some), F.lit(0))).alias("mse"), i.alias("i"), F.get(F.lit(list(candidates)), i).alias("w"))

    return F.array_min(F.filter(F.transform(each, scored), lambda x: x["mse"].isNotNull()))


def cv_window(df: DataFrame, keys: list[str], value: str, candidates: list[int], folds: int = 5, seed: int = 42, order: str = "date", longest: int | None = None) -> DataFrame:
    """``keys, n, best, mse``: for each series the candidate of the least cross-validated error, ties to the first given.

    Positions count rows with a value. A point is predicted by the mean of the others' training points in its window; a
    fold's error is the mean square over points that have a prediction, a candidate's the mean over folds. Series with
    fewer points than folds have no row. One exchange by the keys serves the windows and the aggregation, and no job runs
    before the plan is used. ``longest`` is the number of points that no series exceeds, if that is known: then all stays
    in the JVM (see :func:`fold_of`).
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("_v"))
    rows = _squares(rows, keys, candidates, folds, seed, order, longest).where(F.col("_fold").isNotNull())
    found = rows.groupBy(*keys, "_n").agg(_best(candidates, folds, F.avg).alias("b"))
    return found.where(F.col("b").isNotNull()).select(*keys, F.col("_n").alias("n"), F.col("b.w").alias("best"), F.col("b.mse").alias("mse"))


def cv_smooth(df: DataFrame, keys: list[str], value: str, candidates: list[int], folds: int = 5, seed: int = 42, order: str = "date", out: str = "smoothed", longest: int | None = None) -> DataFrame:
    """``df`` and ``best`` and ``out``: each series smoothed over the width that cross-validation selects (null if none).

    As :func:`cv_window`, but rows stay where they are: errors are averaged in windows, so that nothing is joined back.
    """
    by = W.partitionBy(*keys)
    parts = [*keys, "_some"]
    rows = _squares(df.withColumn("_v", F.col(value)).withColumn("_some", F.col(value).isNotNull()), parts, candidates, folds, seed, order, longest)
    rows = rows.withColumn("_b", _best(candidates, folds, lambda c: F.avg(c).over(W.partitionBy(*parts)))).withColumn("best", F.max("_b.w").over(by))
    smoothed = F.coalesce(*[F.when(F.col("best") == w, rolling(F.col(value), w, keys, order)) for w in candidates])
    return rows.withColumn(out, smoothed).select(*df.columns, "best", out)
