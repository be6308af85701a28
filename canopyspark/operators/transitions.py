"""Interpolation, threshold crossings, extrema and signal quality of seasonal series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THRESHOLDS = (0.10, 0.25, 0.50, 0.75, 0.90)


def interpolate(df: DataFrame, keys: list[str], value: str, order: str = "date", by: str | None = None, edges: bool = True, out: str = "filled") -> DataFrame:
    """Fills nulls linearly by row position (or by the column ``by``); with ``edges``, the ends take the nearest value."""
    series = W.partitionBy(*keys).orderBy(order)
    at = F.col(by).cast("double") if by else F.row_number().over(series).cast("double")
    df = df.withColumn("_at", at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).alias("v")))
    df = df.withColumn("_l", F.last(known, True).over(series.rowsBetween(W.unboundedPreceding, 0))).withColumn("_r", F.first(known, True).over(series.rowsBetween(0, W.unboundedFollowing)))
    inside = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * (F.col("_at") - F.col("_l.at")) / (F.col("_r.at") - F.col("_l.at"))
    ends = [F.col("_l.v"), F.col("_r.v")] if edges else []
    return df.withColumn(out, F.coalesce(F.col(value), inside, *ends) if ends else F.coalesce(F.col(value), inside)).drop("_at", "_l", "_r")


def crossings(df: DataFrame, keys: list[str], value: str = "smoothed", doy: str = "doy", order: str = "date", thresholds: tuple[float, ...] = THRESHOLDS, low: int = 60, high: int = 320) -> DataFrame:
    """One row a series and threshold: ``keys, peak, peak_value, baseline, amplitude, pct, up, down``.

    Nulls are interpolated over the whole series, then the season is cut. A threshold lies at baseline + t x amplitude;
    ``up`` is the last upward crossing up to the (first) peak, ``down`` the first downward one from it, as interpolated
    days of the year; touching the threshold counts. Null where there is none. A series without a value in season has
    no row. One exchange by the keys.
    """
    by = W.partitionBy(*keys)
    rows = interpolate(df.select(*keys, order, doy, value), keys, value, order, out="_v").where(F.col(doy).between(low, high) & F.col("_v").isNotNull())
    rows = rows.withColumn("_i", F.row_number().over(by.orderBy(order)))
    rows = rows.withColumn("_v1", F.lead("_v").over(by.orderBy(order))).withColumn("_d1", F.lead(doy).over(by.orderBy(order)))
    rows = rows.withColumn("_p", F.max(F.struct(F.col("_v").alias("v"), (-F.col("_i")).alias("i"), F.col(doy).alias("d"))).over(by)).withColumn("baseline", F.min("_v").over(by))
    amplitude = F.col("_p.v") - F.col("baseline")
    rows = rows.withColumn("amplitude", amplitude).withColumn("_t", F.explode(F.array(*[F.lit(float(t)) for t in sorted(thresholds)])))
    level = F.col("baseline") + F.col("_t") * F.col("amplitude")
    turn = F.signum(F.col("_v1") - level) - F.signum(F.col("_v") - level)
    day = F.col(doy) + (F.col("_d1") - F.col(doy)) * (level - F.col("_v")) / F.nullif(F.col("_v1") - F.col("_v"), F.lit(0.0))
    day = F.coalesce(day, F.col(doy).cast("double"))
    rising = (F.col("_i") < -F.col("_p.i")) & (turn > 0)
    falling = (F.col("_i") >= -F.col("_p.i")) & (turn < 0)
    return rows.groupBy(*keys, F.col("_p.d").alias("peak"), F.col("_p.v").alias("peak_value"), "baseline", "amplitude", F.round(F.col("_t") * 100).cast("int").alias("pct")).agg(
        F.max_by(day, F.when(rising, F.col("_i"))).alias("up"), F.min_by(day, F.when(falling, F.col("_i"))).alias("down")
    )


def transitions(df: DataFrame, keys: list[str], prefix: str = "G", **options) -> DataFrame:
    """One row a series: ``keys, amplitude, baseline, peak_value, dates`` (PEAK, <prefix>U_<pct>, <prefix>D_<pct>)."""
    rows = crossings(df, keys, **options)
    entry = F.array(F.struct(F.concat(F.lit(f"{prefix}U_"), "pct").alias("k"), F.col("up").alias("v")), F.struct(F.concat(F.lit(f"{prefix}D_"), "pct").alias("k"), F.col("down").alias("v")))
    peak = F.array(F.struct(F.lit("PEAK").alias("k"), F.col("peak").cast("double").alias("v")))
    merged = rows.groupBy(*keys, "peak", "amplitude", "baseline", "peak_value").agg(F.flatten(F.array_sort(F.collect_list(entry))).alias("e"))
    return merged.select(*keys, "amplitude", "baseline", "peak_value", F.map_from_entries(F.concat(peak, "e")).alias("dates"))


def extrema(df: DataFrame, keys: list[str], value: str, order: str = "date") -> DataFrame:
    """``keys, at, value, next_at, next_value, amplitude``: turning points and the change to the next one.

    A row is one where the sign of the first difference changes, or where that is unknown (the first two rows, rows
    after nulls) and the row has a value; the first of a series is dropped. The mark is on the row after the turn.
    """
    series = W.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, F.col(order).alias("at"), F.col(value).alias("value"))
    series = W.partitionBy(*keys).orderBy("at")
    sign = F.signum(F.col("value") - F.lag("value").over(series))
    rows = rows.withColumn("_s", sign).withColumn("_c", F.col("_s") - F.lag("_s").over(series))
    marked = rows.where((F.col("_c").isNull() | (F.col("_c") != 0)) & F.col("value").isNotNull())
    marked = marked.withColumn("_i", F.row_number().over(series)).where("_i > 1")
    marked = marked.withColumn("next_at", F.lead("at").over(series)).withColumn("next_value", F.lead("value").over(series))
    return marked.where(F.col("next_at").isNotNull()).select(*keys, "at", "value", "next_at", "next_value", F.abs(F.col("next_value") - F.col("value")).alias("amplitude"))


def cycles(df: DataFrame, keys: list[str], value: str, amplitudes: DataFrame, order: str = "date", ratio: float = 0.5) -> DataFrame:
    """``keys, n_peak``: rises larger than ``ratio`` of the season's amplitude (``keys, amplitude``)."""
    rises = extrema(df, keys, value, order).where(F.col("value") < F.col("next_value")).select(*keys, F.col("amplitude").alias("_rise"))
    return amplitudes.select(*keys, F.col("amplitude").alias("_a")).join(rises, keys, "left").groupBy(*keys).agg(F.count_if(F.col("_rise") > ratio * F.col("_a")).alias("n_peak"))


def snr_db(signal: Column, residual: Column) -> Column:
    """Aggregate: 10 log10 of the variances' ratio; infinite without noise, minus infinite without signal."""
    s, r = F.var_pop(signal), F.var_pop(residual)
    return F.when(r == 0, F.lit(float("inf"))).when(s == 0, F.lit(float("-inf"))).otherwise(10 * F.log10(s / F.nullif(r, F.lit(0.0))))


def signal_quality(df: DataFrame, keys: list[str], raw: str, smoothed: str) -> DataFrame:
    """``keys, noise_std, snr`` of a smoothed series against its raw one."""
    residual = F.col(raw) - F.col(smoothed)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(residual, 2))).alias("noise_std"), snr_db(F.col(smoothed), residual).alias("snr"))


def minmax(df: DataFrame, keys: list[str], value: str, out: str = "scaled") -> DataFrame:
    """Each series scaled to [0, 1]; null where it is flat."""
    by = W.partitionBy(*keys)
    low, high = F.min(value).over(by), F.max(value).over(by)
    return df.withColumn(out, (F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))
