"""Row filters and masks of observation series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(value: Column) -> Column:
    """NaN as null, so that averages skip it."""
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: missing(F.col(c)) for c in columns})


def brightness_filter(df: DataFrame, column: str = "brightness", low: float = 50.0, high: float = 650.0) -> DataFrame:
    """Rows whose brightness lies in [low, high]; null and NaN go. Reaches the scan as a pushed filter."""
    return df.where(F.col(column).between(low, high) & ~F.isnan(column))


def mask_snow(df: DataFrame, snow: DataFrame, values: list[str], keys: tuple[str, ...] = ("location",), ts: str = "ts") -> DataFrame:
    """Null in ``values`` on days flagged 1 in ``snow`` (keys, date, snow); rows stay. Days without a flag are free of snow.

    One flag a key and day; the join is left to Spark, which broadcasts the flags if they are small.
    """
    flags = snow.where(F.col("snow") == 1).select(*keys, F.col("date").alias("_day")).distinct().withColumn("_snow", F.lit(True))
    joined = df.withColumn("_day", F.to_date(ts)).join(flags, [*keys, "_day"], "left")
    return joined.select(*[F.when(F.col("_snow").isNull(), F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def exclude_locations(df: DataFrame, locations: Iterable[str], column: str = "location") -> DataFrame:
    """Rows outside the given locations, compared as strings; a null location stays."""
    gone = [str(x) for x in locations]
    return df.where(F.col(column).isNull() | ~F.col(column).cast("string").isin(gone)) if gone else df


def keep_categories(df: DataFrame, kept: Iterable[str], column: str = "category") -> DataFrame:
    return df.where(F.col(column).isin(list(kept)))


def season(df: DataFrame, low: int = 60, high: int = 320, doy: str = "doy") -> DataFrame:
    """Rows whose day of year lies in [low, high]."""
    return df.where(F.col(doy).between(low, high))


def strided(images: DataFrame, keys: list[str], sample: int = 25) -> DataFrame:
    """About every (n / sample)-th image of a group by path, the first included: at most 2 * sample - 1 a group."""
    from pyspark.sql import Window as W

    group = W.partitionBy(*keys)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(group) / sample))
    picked = images.withColumn("_rn", F.row_number().over(group.orderBy("path")) - 1).withColumn("_step", step).where(F.pmod("_rn", "_step") == 0)
    return picked.drop("_rn", "_step")


def modal_shape(images: DataFrame, keys: list[str], sample: int | None = 25) -> DataFrame:
    """``keys, height, width``: the commonest shape of the :func:`strided` images (of all without ``sample``); ties to the larger area."""
    picked = images if sample is None else strided(images, keys, sample)
    counts = picked.groupBy(*keys, "height", "width").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (F.col("height") * F.col("width")).alias("area"), "height", "width")).alias("b")
    return counts.groupBy(*keys).agg(best).select(*keys, "b.height", "b.width")


def in_units(df: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the units that a second table has, too."""
    return df.join(units.select(*keys).distinct(), keys, "left_semi")


def of_shape(images: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Images of their group's modal shape."""
    return images.join(shapes, [*keys, "height", "width"], "left_semi")


def clip_pooled(df: DataFrame, x: str, y: str, low: float = 0.02, high: float = 0.98, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose x and y both lie within the given quantiles of both columns pooled."""
    pooled = df.select(*keys, F.explode(F.array(x, y)).alias("_v"))
    q = pooled.groupBy(*keys).agg(F.percentile("_v", F.lit(low)).alias("_lo"), F.percentile("_v", F.lit(high)).alias("_hi"))
    joined = df.join(F.broadcast(q), list(keys)) if keys else df.crossJoin(F.broadcast(q))
    return joined.where(F.col(x).between(F.col("_lo"), F.col("_hi")) & F.col(y).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
