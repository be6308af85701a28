"""How regularly a series was observed: coverage, gaps, steps in the sampling rate, the picture nearest to noon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# First and last day of the year of each season.
SEASONS = {"spring": (60, 160), "summer": (161, 230), "autumn": (231, 320)}


def span_days(first: Column, last: Column) -> Column:
    """Whole days between two times (24 hours each), and one."""
    return F.floor((F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 86_400_000_000) + 1


def sampling_flags(df: DataFrame, keys: list[str], ts: str = "ts", seasons: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row a series: first and last day, observations a day, gaps, and for each season coverage and gaps.

    A gap is a step of more than one day of the year between consecutive rows; its length is that step, it starts the day
    after the earlier row. A season with fewer than two rows counts as wholly missing; ``max_gap_days`` looks between
    rows of the season, ``max_consecutive_missing_days`` also at its ends. Rows are counted by date first, in one exchange;
    windows, in a second one by the keys, see a row a series and date, however many rows a date has.
    """
    seasons = seasons or SEASONS
    by = W.partitionBy(*keys)
    label = None
    for name, (a, b) in seasons.items():
        inside = F.col("_d").between(a, b)
        label = F.when(inside, F.lit(name)) if label is None else label.when(inside, F.lit(name))
    rows = df.select(*keys, F.col(ts).alias("_ts"), F.to_date(ts).alias("_date"), F.dayofyear(ts).alias("_d"))
    rows = rows.groupBy(*keys, "_date", "_d").agg(F.count(F.lit(1)).alias("_n"), F.min("_ts").alias("_ts"), F.max("_ts").alias("_end")).withColumn("_s", label)
    line = by.orderBy("_date")
    rows = rows.withColumn("_step", F.abs(F.col("_d") - F.lag("_d").over(line))).withColumn("_before", F.lag("_date").over(line))
    inner = W.partitionBy(*keys, "_s").orderBy("_date")
    rows = rows.withColumn("_sstep", F.greatest(F.abs(F.col("_d") - F.lag("_d").over(inner)), F.when(F.col("_n") > 1, 0)))  # none between rows of a date
    days = W.partitionBy(*keys, "_d")
    rows = rows.withColumn("_same", F.sum("_n").over(days)).withColumn("_fresh", F.row_number().over(days.orderBy("_date")) == 1)
    along = W.partitionBy(*keys, "_s", "_fresh").orderBy("_d")
    rows = rows.withColumn("_hole", F.when(F.col("_fresh"), F.col("_d") - F.lag("_d").over(along) - 1))
    gap = F.col("_step") > 1
    gaps = F.array_sort(F.collect_list(F.when(gap, F.struct(F.col("_before").alias("t"), F.date_format(F.date_add("_before", 1), "yyyy-MM-dd").alias("s"), F.col("_step").alias("n")))))
    first, last, count = F.min("_ts"), F.max("_end"), F.sum("_n")
    out = [
        F.date_format(first, "yyyy-MM-dd").alias("start_date"), F.date_format(last, "yyyy-MM-dd").alias("end_date"),
        (count / span_days(first, last)).alias("avg_obs_per_day"), F.max("_same").cast("int").alias("max_obs_per_day"), F.min("_same").cast("int").alias("min_obs_per_day"),
        F.count_if(gap).cast("int").alias("n_gaps"), F.transform(gaps, lambda g: g["s"]).alias("gap_start_dates"), F.transform(gaps, lambda g: g["n"]).alias("gap_lengths_day"),
    ]
    for name, (a, b) in seasons.items():
        here, whole = F.col("_s") == name, b - a + 1
        n = F.coalesce(F.sum(F.when(here, F.col("_n"))), F.lit(0))
        few = n < 2
        low, high = F.min(F.when(here, F.col("_ts"))), F.max(F.when(here, F.col("_end")))
        ends = F.greatest(F.min(F.when(here, F.col("_d"))) - a, F.lit(b) - F.max(F.when(here, F.col("_d"))), F.coalesce(F.max(F.when(here, F.col("_hole"))), F.lit(0)))
        out += [
            F.when(few, 0.0).otherwise(F.count_if(here & F.col("_fresh")) / whole).alias(f"{name}_coverage_ratio"),
            F.when(few, 0.0).otherwise(n / span_days(low, high)).alias(f"{name}_avg_obs_per_day"),
            F.when(few, 1).otherwise(F.count_if(here & (F.col("_sstep") > 1))).cast("int").alias(f"{name}_n_gaps"),
            F.when(few, whole).otherwise(F.max(F.when(here, F.col("_sstep")))).cast("int").alias(f"{name}_max_gap_days"),
            F.when(few, whole).otherwise(ends).cast("int").alias(f"{name}_max_consecutive_missing_days"),
        ]
    return rows.groupBy(*keys).agg(*out)


def missing_days(df: DataFrame, keys: list[str], low: int, high: int, doy: str = "doy") -> DataFrame:
    """``keys, missing``: the days of the year in [low, high] on which a series has no row, in order; series without a row
    there have none of theirs listed, as they have no row here."""
    inside = df.where(F.col(doy).between(low, high)).groupBy(*keys).agg(F.collect_set(F.col(doy).cast("int")).alias("_seen"))
    return inside.select(*keys, F.array_except(F.sequence(F.lit(low), F.lit(high)), "_seen").alias("missing"))


def modal_year(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``keys, modal_year``: the commonest year of a series, the smallest on a tie."""
    years = df.groupBy(*keys, F.year(ts).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    return years.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col("_y")).alias("y"))).alias("b")).select(*keys, (-F.col("b.y")).alias("modal_year"))


def daily_counts(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``keys, date, doy, n`` for every day of each series' modal year, 0 where nothing was observed.

    Counts by day, then one exchange by the keys: the modal year and the gaps between days are windows.
    """
    by = W.partitionBy(*keys)
    days = df.groupBy(*keys, F.to_date(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_day").isNotNull()).withColumn("_y", F.year("_day"))
    days = days.withColumn("_total", F.sum("_n").over(W.partitionBy(*keys, "_y")))
    days = days.withColumn("_modal", F.max(F.struct("_total", (-F.col("_y")).alias("y"))).over(by)).where(F.col("_y") == -F.col("_modal.y"))
    line = by.orderBy("_day")
    days = days.withColumn("_before", F.lag("_day").over(line)).withColumn("_next", F.lead("_day").over(line))
    first = F.when(F.col("_before").isNull(), F.make_date("_y", F.lit(1), F.lit(1))).otherwise(F.col("_day"))
    last = F.coalesce(F.date_sub("_next", 1), F.make_date("_y", F.lit(12), F.lit(31)))
    filled = days.withColumn("date", F.explode(F.sequence(first, last)))
    return filled.select(*keys, "date", F.dayofyear("date").alias("doy"), F.when(F.col("date") == F.col("_day"), F.col("_n")).otherwise(0).alias("n"))


def _with_shift(df: DataFrame, parts: list[str], value: str, order: str) -> DataFrame:
    """Adds ``_i`` (from 1) and ``_stat``: the standardised shift of the mean after row i, null where no split is judged."""
    by = W.partitionBy(*parts)
    rows = df.withColumn("_i", F.row_number().over(by.orderBy(order))).withColumn("_sum", F.sum(value).over(by.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_total", F.sum(value).over(by))
    shift = F.abs((F.col("_total") - F.col("_sum")) / F.nullif(F.col("_n") - F.col("_i"), F.lit(0)) - F.col("_sum") / F.col("_i"))
    stat = shift * F.sqrt(F.col("_i") * (F.col("_n") - F.col("_i")) / F.col("_n"))
    return rows.withColumn("_stat", F.when((F.col("_i") < F.col("_n")) & (F.col("_n") >= 10), stat)).drop("_sum", "_n", "_total")


def change_point(df: DataFrame, keys: list[str], value: str = "n", order: str = "doy") -> DataFrame:
    """``keys, k, stat``: the split before row k (from 0) that makes the largest standardised shift of the mean, the first on ties."""
    rows = _with_shift(df, keys, value, order).where(F.col("_stat").isNotNull())
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col("_stat").alias("stat"), (-F.col("_i")).alias("i"))).alias("b")).select(*keys, (-F.col("b.i")).cast("int").alias("k"), F.col("b.stat").alias("stat"))


def step_detector(df: DataFrame, keys: list[str], ts: str = "ts", low: int = 60, high: int = 320) -> DataFrame:
    """Whether a series steps from one observation a day to three or more within its year.

    ``keys, detected, best_doy, stat, med_before, med_after, frac_before_1, frac_after_ge2, sharp, reason``. The
    change point is sought in season, what lies before and after it in the whole year. ``reason`` says why no split was
    judged ("pre_filter", "too_few_obs"); best_doy is given wherever one was.
    """
    counts = daily_counts(df, keys, ts).withColumn("_in", F.col("doy").between(low, high))
    rows = _with_shift(counts, [*keys, "_in"], "n", "doy")
    found = F.when(F.col("_in") & F.col("_stat").isNotNull(), F.struct(F.col("_stat").alias("stat"), (-F.col("_i")).alias("i")))
    rows = rows.withColumn("_best", F.max(found).over(W.partitionBy(*keys)))
    rows = rows.withColumn("k", (-F.col("_best.i") + low - 1).cast("int")).withColumn("stat", F.col("_best.stat"))
    here, before = F.col("n") > 0, F.col("doy") <= F.col("k")
    one = lambda c, v: F.when(c, v)
    out = rows.groupBy(*keys, "k", "stat").agg(
        F.min(one(here, F.col("n"))).alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"),
        F.count_if(here & before).alias("nb"), F.count_if(here & ~before).alias("na"),
        F.percentile(one(here & before, F.col("n")), F.lit(0.5)).alias("med_before"), F.percentile(one(here & ~before, F.col("n")), F.lit(0.5)).alias("med_after"),
        F.avg(one(here & before, (F.col("n") == 1).cast("double"))).alias("frac_before_1"), F.avg(one(here & ~before, (F.col("n") >= 2).cast("double"))).alias("frac_after_ge2"),
        F.max(one(F.col("doy") == F.col("k") - 4, F.col("n"))).alias("w0"), F.max(one(F.col("doy") == F.col("k") + 5, F.col("n"))).alias("w1"),
    )
    reason = F.when((F.coalesce("least", F.lit(0)) != 1) | (F.col("most") < 3) | (F.col("mean") < 0.3), "pre_filter").when((F.col("nb") < 10) | (F.col("na") < 10), "too_few_obs")
    out = out.withColumn("reason", reason).withColumn("sharp", (F.col("w1") >= 2) & (F.col("w0") <= 1))
    rule = (F.col("med_before") == 1) & (F.col("med_after") >= 3) & (F.col("frac_before_1") >= 0.8) & (F.col("frac_after_ge2") >= 0.8) & F.col("sharp")
    judged = F.col("reason").isNull()
    named = ["stat", "med_before", "med_after", "frac_before_1", "frac_after_ge2", "sharp"]
    return out.select(*keys, (judged & rule).alias("detected"), F.when(judged, F.col("k") + 1).cast("int").alias("best_doy"), *[F.when(judged, F.col(c)).alias(c) for c in named], "reason")


def closest_to_noon(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The rows nearest to 12:00 of each day, the earlier time on a tie; rows that share the chosen time all stay."""
    seconds = F.abs(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) - 43_200)
    best = W.partitionBy(*keys, F.to_date(ts)).orderBy(seconds, ts)
    return df.withColumn("_rank", F.rank().over(best)).where("_rank = 1").drop("_rank")


def noon_where_stepped(df: DataFrame, detected: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Only the rows nearest to noon in series where a step was detected (``keys, detected``), all rows elsewhere."""
    rows = df.join(detected.select(*keys, "detected"), keys, "left")
    seconds = F.abs(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) - 43_200)
    rows = rows.withColumn("_rank", F.rank().over(W.partitionBy(*keys, F.to_date(ts)).orderBy(seconds, ts)))
    return rows.where((F.col("_rank") == 1) | ~F.coalesce("detected", F.lit(False))).drop("_rank", "detected")
