"""Monte-Carlo uncertainty of transition dates: seeded noise, a vectorised kernel a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept, ship
from .smooth import fold_ids
from .transitions import THRESHOLDS


def _running(rows: np.ndarray) -> np.ndarray:
    """Sums of the rows before each, and of all."""
    out = np.zeros((len(rows) + 1, *rows.shape[1:]))
    np.cumsum(rows, axis=0, out=out[1:])
    return out


class Copies:
    """Noisy copies of one series, a row a point and a column a copy. All have their gaps where the series has its own.

    Running sums over all points, and over the points of each fold, are made once; any window is a difference of two
    rows of them, so a further width costs a few passes over the copies, whatever the folds.
    """

    def __init__(self, values: np.ndarray, folds: int, seed: int):
        self.values, n = values, len(values)
        self.known = ~np.isnan(values[:, 0])
        filled = np.where(self.known[:, None], values, 0.0)
        self.fold = fold_ids(n, folds, seed)
        self.sums, self.counts = _running(filled), _running(self.known.astype(float))
        self.members = [np.flatnonzero(self.fold == f) for f in range(folds)]
        self.fold_sums, self.fold_counts = [], []
        for own in self.members:  # the fold's sum before a point is that before its next member
            self.fold_sums.append(_running(filled[own]))
            self.fold_counts.append(_running(self.known[own].astype(float)))

    def ends(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        at, half = np.arange(len(self.values)), window // 2
        return np.maximum(at - half, 0), np.minimum(at + half + 1, len(at))

    def smooth(self, window: int, chosen: np.ndarray) -> np.ndarray:
        """Centered means of the chosen copies, NaN at gaps."""
        lo, hi = self.ends(window)
        sums = self.sums[:, chosen]
        with np.errstate(invalid="ignore", divide="ignore"):
            means = (sums[hi] - sums[lo]) / (self.counts[hi] - self.counts[lo])[:, None]
        means[~self.known] = np.nan
        return means

    def errors(self, candidates: list[int]) -> np.ndarray:
        """Cross-validated error of each candidate width for each copy (NaN if no point can be predicted)."""
        out = np.full((len(candidates), self.values.shape[1]), np.nan)
        for c, w in enumerate(candidates):
            lo, hi = self.ends(w)
            found = []
            for own, sums, counts in zip(self.members, self.fold_sums, self.fold_counts, strict=True):
                a, b = lo[own], hi[own]
                i, j = np.searchsorted(own, a), np.searchsorted(own, b)
                n = self.counts[b] - self.counts[a] - (counts[j] - counts[i])
                use = (n > 0) & self.known[own]
                if not use.any():
                    continue
                a, b, i, j = a[use], b[use], i[use], j[use]
                others = self.sums[b] - self.sums[a] - (sums[j] - sums[i])
                others /= n[use, None]
                others -= self.values[own[use]]
                found.append(np.einsum("ij,ij->j", others, others) / use.sum())
            if found:
                out[c] = np.mean(found, axis=0)
        return out


def filled_gaps(values: np.ndarray) -> np.ndarray:
    """Linear interpolation by position, of all columns at once (their gaps are the same); the ends take the nearest value."""
    known = np.flatnonzero(~np.isnan(values[:, 0])) if values.size else np.empty(0, int)
    if not len(known) or len(known) == len(values):
        return values
    at = np.arange(len(values))
    place = np.interp(at, known, np.arange(len(known)))  # a point's place among the known ones
    left = np.floor(place).astype(int)
    right = np.minimum(left + 1, len(known) - 1)
    share = (place - left)[:, None]
    return values[known[left]] * (1 - share) + values[known[right]] * share


def transition_days(doy: np.ndarray, values: np.ndarray, thresholds: tuple[float, ...], low: int, high: int) -> np.ndarray:
    """Peak day, then up and down crossings of each threshold, a row a date and a column a copy (NaN where there is none)."""
    keep = (doy >= low) & (doy <= high)
    days, v = doy[keep].astype(float), filled_gaps(values)[keep]
    copies = v.shape[1]
    out = np.full((1 + 2 * len(thresholds), copies), np.nan)
    if not len(v) or np.isnan(v[0]).all():
        return out
    peak, base, column = v.argmax(0), v.min(0), np.arange(copies)
    amplitude = v[peak, column] - base
    out[0] = days[peak]
    before = np.arange(len(v) - 1)[:, None] < peak
    for i, t in enumerate(thresholds):
        level = base + t * amplitude
        side = (v > level).view(np.int8) - (v < level).view(np.int8)
        up, down = (side[1:] > side[:-1]) & before, (side[1:] < side[:-1]) & ~before
        for j, hit in enumerate((up, down)):
            if not len(hit):
                continue
            at = len(hit) - 1 - hit[::-1].argmax(0) if j == 0 else hit.argmax(0)
            y0, y1 = v[at, column], v[at + 1, column]
            with np.errstate(invalid="ignore", divide="ignore"):
                day = days[at] + (days[at + 1] - days[at]) * (level - y0) / (y1 - y0)
            out[1 + 2 * i + j] = np.where(hit[at, column], np.where(y1 == y0, days[at], day), np.nan)
    return out


def simulate(doy: np.ndarray, smoothed: np.ndarray, noise: float, rng: np.random.Generator, iterations: int, candidates: list[int], folds: int, thresholds: tuple[float, ...], low: int, high: int) -> np.ndarray:
    """Sample standard deviation of peak, ups and downs over noisy copies of a smoothed series, each smoothed anew."""
    if len(smoothed) < folds or np.isnan(noise):
        return np.full(1 + 2 * len(thresholds), np.nan)
    noisy = np.ascontiguousarray((smoothed[None, :] + rng.normal(0, noise, (iterations, len(smoothed)))).T)
    copies = Copies(noisy, folds, 42)
    errors = copies.errors(candidates)
    usable = ~np.isnan(errors).all(0)
    best = np.where(np.isnan(errors), np.inf, errors).argmin(0)
    found = np.full((1 + 2 * len(thresholds), iterations), np.nan)
    for c, w in enumerate(candidates):
        mine = usable & (best == c)
        if mine.any():
            found[:, mine] = transition_days(doy, copies.smooth(w, mine), thresholds, low, high)
    count = (~np.isnan(found)).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.nansum(found, 1) / count
        return np.where(count > 1, np.sqrt(np.nansum((found - mean[:, None]) ** 2, 1) / (count - 1)), np.nan)


def series_numbers(units: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, unit``: the place of each series in the sorted order of all, from 0, which seeds its noise.

    Two steps, so that no task holds all series: positions within sorted ranges, and running totals of range sizes. The
    ranges are kept before both steps read them, or each could see other ranges.
    """
    from pyspark.sql import Window as W

    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(units.select(*keys).distinct().repartitionByRange(parts, *keys).withColumn("_p", F.spark_partition_id()))
    placed = ranged.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*keys)) - 1)
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(starts, "_p").select(*keys, (F.col("_start") + F.col("_i")).cast("int").alias("unit"))


def uncertainties(df: DataFrame, keys: list[str], raw: str, smoothed: str, candidates: list[int], seed: int, iterations: int = 1000, folds: int = 5, thresholds: tuple[float, ...] = THRESHOLDS, low: int = 60, high: int = 320, prefix: str = "G", doy: str = "doy", order: str = "date", numbers: DataFrame | None = None) -> DataFrame:
    """``keys, noise_std`` and, a date key, its standard deviation ``<key>_std`` over ``iterations`` noisy copies.

    Noise has the standard deviation of raw against smoothed values and is added to the smoothed series; the width is
    selected anew for each copy. Series i in sorted order draws from child i of the master seed, so results don't
    depend on partitions; ``numbers`` (``keys, unit``) can give these numbers. A series is one task's work: at most 366
    points times the iterations.
    """
    ship(df.sparkSession)
    marks = sorted(thresholds)
    names = [f"{prefix}{d}_{round(t * 100)}_std" for t in marks for d in "UD"]
    fields = df.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", noise_std double, PEAK_std double, " + ", ".join(f"{n} double" for n in names)
    numbered = df.join(numbers if numbers is not None else series_numbers(df, keys), keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        s, r = pdf[smoothed].to_numpy(float), pdf[raw].to_numpy(float)
        gap = (r - s) ** 2
        noise = float(np.sqrt(np.nanmean(gap))) if (~np.isnan(gap)).any() else float("nan")
        rng = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(int(pdf.unit.iloc[0]),)))
        found = simulate(pdf[doy].to_numpy(), s, noise, rng, iterations, candidates, folds, tuple(marks), low, high)
        return pd.DataFrame([[*pdf[keys].iloc[0].tolist(), noise, *found]], columns=[*keys, "noise_std", "PEAK_std", *names])

    # Few rows make much work here: a stated number of parts isn't merged for being small, as one left to Spark would be (and
    # with the usual number Spark takes the step for superfluous).
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    dealt = numbered.select(*dict.fromkeys([*keys, "unit", order, doy, raw, smoothed])).repartition(parts, *keys)
    return dealt.groupBy(*keys).applyInPandas(run, schema)
