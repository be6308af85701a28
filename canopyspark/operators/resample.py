"""Daily and multi-day products of observation series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRATEGIES = ("avg", "p50", "p75", "p90")


def _grouped(rows: DataFrame, by: list[str], value: str, strategies: tuple[str, ...], *others: Column) -> DataFrame:
    """``by``, ``others`` and a column a strategy over the groups. Quantiles are exact and interpolated: they come from the
    ranks of one sorted window, so that no group is held in memory."""
    if wrong := [s for s in strategies if s not in STRATEGIES]:
        raise ValueError(f"unknown strategies {wrong}")
    if any(s != "avg" for s in strategies):
        group = W.partitionBy(*by)
        rows = rows.withColumn("_rank", F.row_number().over(group.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(group))

    def of(strategy: str) -> Column:
        if strategy == "avg":
            return F.avg(value)
        at = (F.col("_n") - 1) * (int(strategy[1:]) / 100) + 1
        part = at - F.floor(at)
        weight = F.when(F.col("_rank") == F.floor(at), 1 - part).when(F.col("_rank") == F.floor(at) + 1, part)
        return F.sum(F.when(weight > 0, weight * F.col(value)))

    return rows.groupBy(*by).agg(*others, *[of(s).alias(s) for s in strategies])


def daily_product(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", strategies: tuple[str, ...] = STRATEGIES, fill: bool = True, counts: str | None = None) -> DataFrame:
    """``keys, date, doy`` and a column a strategy: each day from the first to the last with a value, empty days null.

    Without ``fill`` empty days are left out; then ``counts`` can name a column for the number of a day's values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.to_date(ts).alias("date"), F.col(value).alias("_v"))
    others = [F.count(F.lit(1)).alias(counts)] if counts and not fill else []
    days = _grouped(rows, [*keys, "date"], "_v", strategies, *others)
    if not fill:
        return days.select(*keys, "date", F.dayofyear("date").alias("doy"), *strategies, *([counts] if others else []))
    following = F.lead("date").over(W.partitionBy(*keys).orderBy("date"))
    days = days.withColumn("_until", F.coalesce(F.date_sub(following, 1), F.col("date")))
    filled = days.withColumn("_day", F.explode(F.sequence("date", "_until")))
    real = F.col("_day") == F.col("date")
    return filled.select(*keys, F.col("_day").alias("date"), F.dayofyear("_day").alias("doy"), *[F.when(real, F.col(s)).alias(s) for s in strategies])


def binned_product(df: DataFrame, keys: list[str], days: int = 3, ts: str = "ts", value: str = "value", strategies: tuple[str, ...] = STRATEGIES, first_doy: int = 2) -> DataFrame:
    """``keys, date, doy`` and a column a strategy: bins of ``days`` days of the year from ``first_doy`` on, only those with values.

    A bin's date is its first day in the year of the series' first row. Earlier days of the year belong to no bin.
    """
    doy = F.dayofyear(ts)
    label = F.lit(first_doy) + F.floor((doy - first_doy) / days).cast("int") * days
    rows = df.where(F.col(value).isNotNull() & (doy >= first_doy)).select(*keys, label.alias("_bin"), F.year(ts).alias("_year"), F.col(value).alias("_v"))
    bins = _grouped(rows, [*keys, "_bin"], "_v", strategies, F.min("_year").alias("_y"))
    year = F.min("_y").over(W.partitionBy(*keys))
    return bins.select(*keys, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.col("_bin") - 1).alias("date"), F.col("_bin").alias("doy"), *strategies)


def product(df: DataFrame, keys: list[str], window: str = "3D", **options) -> DataFrame:
    """The product of a window such as "1D" or "3D"."""
    days = int(window.rstrip("D"))
    return daily_product(df, keys, **options) if days == 1 else binned_product(df, keys, days, **options)


def long_product(wide: DataFrame, keys: list[str], strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """One row a strategy: ``keys, date, doy, strategy, value``."""
    return wide.unpivot([*keys, "date", "doy"], list(strategies), "strategy", "value")
