"""Analyses of the record table: counts, seasons, profiles, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import dealt, kept


def with_sites(records: DataFrame, sites: DataFrame, overrides: dict[str, str] | None = None, location: str = "location") -> DataFrame:
    """Adds ``elevation, elevation_band, site, image_type`` to records by their location, from ``ID, Location, Elevation``.

    A location that isn't listed has no elevation and its own name as site; ``overrides`` (location -> name) come first.
    One row an ID counts; the join is left to Spark, which broadcasts the sites if they are small.
    """
    from ..functions import expressions as X

    one = sites.groupBy(F.col("ID").cast("string").alias("_id")).agg(F.max_by("Elevation", "Location").alias("elevation"), F.max("Location").alias("_name"))
    place = F.col(location).cast("string")
    joined = records.join(one, place == F.col("_id"), "left")
    label = X.site_label(F.coalesce("_name", place))
    for name, shown in (overrides or {}).items():
        label = F.when(place == name, shown).otherwise(label)
    return joined.withColumns({"elevation_band": X.elevation_band(F.col("elevation")), "site": label, "image_type": X.camera_type(place)}).drop("_id", "_name")


def species_counts(records: DataFrame, least: int = 50, species: str = "species", uid: str = "uid") -> DataFrame:
    """Q1: series and distinct individuals of each species with at least ``least`` series."""
    groups = records.where(F.col(species).isNotNull()).groupBy(species).agg(F.count(F.lit(1)).alias("n_series"), F.countDistinct(uid).alias("n_uid"))
    return groups.where(F.col("n_series") >= least).orderBy(F.desc("n_series"), species)


def curated_against_full(curated: DataFrame, full: DataFrame, species: str = "species") -> DataFrame:
    """Q2: rows of each species in both tables, 0 where it is in one."""
    one = curated.where(F.col(species).isNotNull()).groupBy(species).agg(F.count(F.lit(1)).alias("curated"))
    two = full.where(F.col(species).isNotNull()).groupBy(species).agg(F.count(F.lit(1)).alias("full"))
    return one.join(two, species, "full_outer").na.fill(0, ["curated", "full"]).orderBy(F.desc("curated"), F.desc("full"), species)


def presence(records: DataFrame, sites: list, site: str = "site", year: str = "year", start: DataFrame | None = None) -> DataFrame:
    """Q3: one row a year, one column a site: 1 present, 0 absent, -1 before the site's first year; and ``present``.

    ``sites`` lists the columns. The years are all that occur.
    """
    first = (start or records).groupBy(site).agg(F.min(year).alias("_first"))
    years = records.select(year).distinct()
    here = records.select(site, year).distinct().withColumn("_here", F.lit(1))
    state = first.crossJoin(F.broadcast(years)).join(here, [site, year], "left").withColumn("_s", F.when(F.col("_here") == 1, 1).when(F.col(year) < F.col("_first"), -1).otherwise(0))
    wide = state.groupBy(year).pivot(site, sites).agg(F.max("_s"))
    wide = wide.select(F.col(year), *[F.coalesce(F.col(f"`{s}`"), F.lit(-1)).alias(str(s)) for s in sites])
    return wide.withColumn("present", sum((F.when(F.col(f"`{s}`") == 1, 1).otherwise(0) for s in sites), F.lit(0)))


def series_per_site_year(records: DataFrame, sites: list, site: str = "site", year: str = "year") -> DataFrame:
    """Q4: rows of each year and site, one column a site, and their ``total``."""
    wide = records.groupBy(year).pivot(site, sites).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("total", sum((F.col(f"`{s}`") for s in sites), F.lit(0)))


def observations_per_day(observations: DataFrame, keys: list[str], ts: str = "ts", over: list[str] | None = None) -> DataFrame:
    """Q5: times a day with any (distinct times of each of ``keys``), the largest of the series in ``over``."""
    one = observations.groupBy(*keys).agg((F.countDistinct(ts) / F.countDistinct(F.to_date(ts))).alias("per_day"))
    return one if over is None else one.groupBy(*over).agg(F.max("per_day").alias("per_day"))


def group_stats(df: DataFrame, by: list[str], values: list[str], distinct: str | None = None) -> DataFrame:
    """Q6, Q7: mean, sample deviation and count of each value in each group (rows with a null key don't count)."""
    for k in by:
        df = df.where(F.col(k).isNotNull())
    found = [c for v in values for c in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_n"))]
    return df.groupBy(*by).agg(*found, *([F.countDistinct(distinct).alias("n_distinct")] if distinct else []))


def half_widths(df: DataFrame, columns: list[str], factor: float = 1.96) -> DataFrame:
    """Q8: half-widths of 95 % intervals: mean deviations times ``factor``; one row a column."""
    return df.select(*columns).unpivot([], columns, "phase", "std").groupBy("phase").agg((F.avg("std") * factor).alias("half_width"))


#: Lots are looked at one by one from SPAN deviations and CLASSES rows before the place where a draw's last lot is expected
#: to that far behind it.
CLASSES, SPAN = 4, 6
#: Equal rows are dealt in blocks of so many.
BLOCK = 256


def balanced_means(df: DataFrame, strata: list[str], group: str, values: list[str], draws: int = 100, seed: int = 0, key: str = "uid") -> DataFrame:
    """Q9: means of ``values`` by ``group`` over draws that take as many rows of each stratum as the smallest has.

    Each row of each draw has a lot of its own, a hash of the seed, the draw, the row's key and values, and its number
    among equal rows; a draw takes the rows of the least lots of a stratum, and the means over draws are averaged. Rows
    whose stratum or group is null don't count; null values don't count in a mean.

    Lots are spread evenly, so the place of a draw's last one is known but for a few deviations, which grow as the root of
    the rows. Rows well before it are summed where they are, rows well behind it are dropped, and only those between are
    exchanged and sorted. Counts tell whether the place lies between; draws where it doesn't are sorted as a whole, so that
    each is exact whatever the lots are. Runs jobs; the strata are broadcast, and a row a stratum and draw is kept.
    """
    by, named = [*strata, group], [*dict.fromkeys([key, *values])]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).groupBy(*dict.fromkeys([*by, *named])).agg(F.count(F.lit(1)).alias("_m"))
    sizes = rows.groupBy(*by).agg(F.sum("_m").alias("_c"))
    sizes = kept(sizes.crossJoin(F.broadcast(sizes.agg(F.min("_c").alias("_n")))))  # one row a stratum
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / BLOCK))))
    blocks = dealt(blocks, *dict.fromkeys([*by, *named, "_block"]))  # a row makes ``draws`` lots
    copies = F.sequence(F.col("_block") * BLOCK + 1, F.least(F.col("_m"), (F.col("_block") + 1) * BLOCK))

    def drawn(todo: DataFrame, each: Column) -> DataFrame:
        """A row a draw of ``todo``: sums over the rows that it takes, and whether their number is right.

        A group is a lot between ``_low`` and ``_high``, or all before, or all behind; no filter, which would be pushed to
        where it makes each lot a second time.
        """
        lots = blocks.join(F.broadcast(todo), by).withColumn("_copy", F.explode(copies))
        lots = lots.withColumn("_row", F.concat_ws("|", *[F.col(c).cast("string") for c in dict.fromkeys([*named, "_copy"])])).withColumn("_draw", F.explode(each))
        lots = lots.withColumn("_lot", F.md5(F.concat("_draw", "_row").cast("binary")))
        lots = lots.withColumn("_class", F.when(F.col("_lot") < F.col("_low"), 0).when(F.col("_lot") < F.col("_high"), 1).otherwise(2))
        own = {"_class": F.col("_class"), **{f"_o{i}": F.when(F.col("_class") == 1, F.col(c)) for i, c in enumerate(["_lot", *named, "_copy"])}}
        sums = [x for i, v in enumerate(values) for x in (F.sum(v).alias(f"_s{i}"), F.count(v).alias(f"_v{i}"))]
        groups = lots.groupBy(*by, "_draw", "_n", *[c.alias(n) for n, c in own.items()]).agg(F.count(F.lit(1)).alias("_k"), *sums)
        line = W.partitionBy("_draw", *by)
        groups = groups.withColumn("_until", F.sum("_k").over(line.orderBy(*own)))
        taken = F.col("_until") <= F.col("_n")
        sums = [F.sum(F.when(taken, F.col(f"_{x}{i}"))).alias(f"_{x}{i}") for i in range(len(values)) for x in "sv"]
        return groups.groupBy("_draw", *by).agg((F.sum(F.when(taken, F.col("_k"))) == F.first("_n")).alias("_ok"), *sums)

    # Where lots begin to be looked at and where they end, as first digits; "" lies below all and "g" above.
    share, slack = F.col("_n") / F.col("_c"), (SPAN * F.sqrt(F.col("_n") * (1 - F.col("_n") / F.col("_c"))) + CLASSES) / F.col("_c")
    edge = lambda x: F.lower(F.lpad(F.hex((x * (1 << 48)).cast("long")), 12, "0"))
    low, high = F.when(share - slack <= 0, "").otherwise(edge(share - slack)), F.when(share + slack >= 1, "g").otherwise(edge(share + slack))
    every = F.array(*[F.lit(f"{seed}|{d}|") for d in range(draws)]).cast("array<string>")  # what the lots of each draw are made of
    found = kept(drawn(sizes.select(*by, "_n", F.when(share >= 1, "g").otherwise(low).alias("_low"), high.alias("_high")), every))
    done = found.where("_ok")
    left = sizes.select(*by, "_n", F.explode(every).alias("_draw")).join(done, [*by, "_draw"], "left_anti")
    if not left.isEmpty():
        left = left.groupBy(*by, "_n").agg(F.collect_list("_draw").alias("_draws")).withColumns({"_low": F.lit(""), "_high": F.lit("g")})
        done = done.unionByName(drawn(left, F.col("_draws")))
    totals = done.groupBy("_draw", group).agg(*[F.sum(f"_{x}{i}").alias(f"_{x}{i}") for i in range(len(values)) for x in "sv"])
    means = totals.select(group, *[(F.col(f"_s{i}") / F.nullif(F.col(f"_v{i}"), F.lit(0))).alias(v) for i, v in enumerate(values)])
    return means.groupBy(group).agg(*[F.avg(v).alias(v) for v in values])


def profile_bands(profiles: DataFrame, group: list[str], value: str, doy: str = "doy", levels: tuple[float, ...] = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)) -> DataFrame:
    """Q10: quantiles of scaled profiles for each day of the year, one column a level (``q05``...)."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in levels]))
    bands = profiles.where(F.col(value).isNotNull()).groupBy(*group, doy).agg(q.alias("_q"), F.count(F.lit(1)).alias("n"))
    return bands.select(*group, doy, "n", *[F.col("_q")[i].alias(f"q{round(x * 100):02d}") for i, x in enumerate(levels)])


def profiles(records: DataFrame, smoothed: DataFrame, keys: list[str], columns: list[str], phases: list[str] | None = None) -> DataFrame:
    """Q10: ``keys, doy, scaled``: smoothed series of the records, each scaled to [0, 1].

    The value is the first of ``columns`` that the table has and that isn't null. Records without a series have no rows;
    with ``phases``, neither have those that lack one of these dates.
    """
    from .transitions import minmax

    chosen = records if not phases else records.dropna(subset=phases)
    value = F.coalesce(*[F.col(f"`{c}`") for c in columns if c in smoothed.columns])
    rows = smoothed.select(*keys, "doy", value.alias("value")).where(F.col("value").isNotNull())
    return minmax(rows.join(chosen.select(*keys).distinct(), keys), keys, "value").select(*keys, "doy", "scaled")


def phase_markers(records: DataFrame, phases: list[str], by: list[str]) -> DataFrame:
    """Q10: median, mean and deviation of each phase in each group."""
    long = records.unpivot(by, phases, "phase", "day")
    return long.where(F.col("day").isNotNull()).groupBy(*by, "phase").agg(F.percentile("day", F.lit(0.5)).alias("median"), F.avg("day").alias("mean"), F.stddev_samp("day").alias("std"))


def agreement(x: str, y: str) -> list[Column]:
    """Aggregates that compare y (camera) with x (reference): n, R2, slope, intercept, bias, RMSE."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    gap = F.col(y) - F.col(x)
    return [
        F.count_if(both).alias("n"), F.regr_r2(y, x).alias("r2"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.avg(gap).alias("bias"), F.sqrt(F.avg(F.pow(gap, 2))).alias("rmse"),
    ]


def network_validation(camera: DataFrame, network: DataFrame, keys: list[str], columns: list[str], reference: str, more_than: int = 5) -> DataFrame:
    """Q11, Q12: each column's group means (of groups with more than ``more_than`` rows) against the network's; one row a column."""
    means = camera.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in columns])
    paired = means.where(F.col("_n") > more_than).join(network.select(*keys, F.col(reference).alias("_ref")), keys)
    long = paired.unpivot(["_ref"], columns, "threshold", "value").where(F.col("value").isNotNull() & F.col("_ref").isNotNull())
    return long.groupBy("threshold").agg(*agreement("_ref", "value"))


def visual_validation(records: DataFrame, visual: DataFrame, key: str, thresholds: list[str], phases: list[str], least: int = 10, clip: tuple[float, float] | None = None) -> DataFrame:
    """Q13: each threshold's day against each visual phase's, one row a pair with at least ``least`` complete rows.

    ``clip`` first keeps the pairs between two quantiles of both columns pooled, for each combination.
    """
    from .filters import clip_pooled

    ours = records.select(key, *thresholds).unpivot([key], thresholds, "threshold", "value")
    theirs = visual.select(key, *phases).unpivot([key], phases, "phase", "seen")
    pairs = ours.join(theirs, key).where(F.col("value").isNotNull() & F.col("seen").isNotNull())
    if clip:
        pairs = clip_pooled(pairs, "seen", "value", *clip, keys=("threshold", "phase"))
    return pairs.groupBy("threshold", "phase").agg(*agreement("seen", "value")).where(F.col("n") >= least)


def best_phase(validation: DataFrame, phases: list[str]) -> DataFrame:
    """Q14: RMSE by threshold, one column a phase, and the ``best`` of them."""
    wide = validation.groupBy("threshold").pivot("phase", phases).agg(F.first("rmse"))
    errors = F.filter(F.array(*[F.struct(F.col(f"`{p}`").alias("r"), F.lit(p).alias("p")) for p in phases]), lambda e: e["r"].isNotNull())
    return wide.withColumn("best", F.array_min(errors)["p"])


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of a column's values, most first, ties by value; only the first ``top`` if given."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out.limit(top) if top else out


def row_at_fraction(df: DataFrame, keys: list[str], order: str, fraction: float = 0.5) -> DataFrame:
    """The row at a fraction of each group's sorted rows."""
    ranked = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") * fraction) + 1).drop("_n", "_r")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one that comes last by ``order``."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
