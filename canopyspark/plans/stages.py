"""The four stages as plans over all units at once; each unit gets a status instead of a branch."""

from __future__ import annotations

import json
import logging
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chroma
from ..functions import expressions as X
from ..functions.geometry import mask_pixels, shrunk_ring
from ..operators import filters, montecarlo, records, resample, sampling, smooth, transitions
from ..session import kept, ship
from ..sources import files
from ..sources.files import KEYS
from .config import Aggregation, Extraction, Modelling, Processing

log = logging.getLogger(__name__)
SITE_YEAR = ["location", "sublocation", "year"]
#: Masks go to the workers by broadcast up to this size.
MASK_BYTES = 64 << 20


# Stage 1


def regions(polygons: DataFrame, categories: list[str], ratios: list[int]) -> DataFrame:
    """Long table of rings: the region's fields, ``ring`` ("" or "_s<ratio>"), ``coords`` and ``area``; degenerate shrunk rings are left out."""
    chosen = filters.keep_categories(polygons, categories)
    rings = chosen.withColumn("ring", F.lit(""))
    for r in ratios:
        rings = rings.unionByName(chosen.withColumn("coords", shrunk_ring(F.col("coords"), r)).where(F.col("coords").isNotNull()).withColumn("ring", F.lit(f"_s{r}")))
    return rings.withColumn("area", X.shoelace(F.col("coords"))).withColumn("polygon_width", X.extent(F.col("coords"), 0)).withColumn("polygon_height", X.extent(F.col("coords"), 1))


def extract(pictures: DataFrame, rings: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """``location, sublocation, year, annotation_id, ring, ts, gcc, rcc, bcc, brightness``.

    Pictures of another shape than their site-year's commonest are left out, as are rings without a pixel. A picture that
    can't be evaluated has no rows. Of pictures with one time, the last path counts. The pixels never move: masks go to
    the pictures, and only ratios are exchanged. ``shapes`` (site-year, height, width) come from a sample of the files'
    first bytes in :func:`run_extraction`, so each picture is decoded once; without them, ``pictures`` are read twice.
    """
    ship(pictures.sparkSession)
    if shapes is None:
        shapes = filters.modal_shape(pictures.select(*SITE_YEAR, "path", "height", "width"), SITE_YEAR)
    masks = rings.join(shapes, SITE_YEAR).withColumn("pixels", mask_pixels(F.col("coords"), F.col("height"), F.col("width"))).where(F.size("pixels") > 0)
    grouped = kept(masks.groupBy(*SITE_YEAR, "height", "width").agg(F.collect_list(F.struct("annotation_id", "ring", "pixels")).alias("masks")))
    size = grouped.agg(F.sum(F.aggregate("masks", F.lit(0).cast("long"), lambda n, m: n + F.size(m["pixels"])))).first()[0] or 0
    joined = pictures.join(F.broadcast(grouped) if 4 * size <= MASK_BYTES else grouped, [*SITE_YEAR, "height", "width"])
    names = [*SITE_YEAR, "path", "ts", "annotation_id", "ring", "gcc", "rcc", "bcc", "brightness"]

    def evaluate(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)
                    found = chroma.region_ratios(pixels, [np.asarray(m["pixels"]) for m in row.masks])
                except ValueError:
                    continue
                out += [[row.location, row.sublocation, row.year, row.path, row.ts, m["annotation_id"], m["ring"], *map(float, v)] for m, v in zip(row.masks, found, strict=True)]
            yield pd.DataFrame(out, columns=names)

    schema = "location string, sublocation string, year string, path string, ts timestamp_ntz, annotation_id string, ring string, gcc double, rcc double, bcc double, brightness double"
    rows = joined.select(*SITE_YEAR, "path", "ts", "height", "width", "data", "masks").mapInPandas(evaluate, schema)
    last = F.max_by(F.struct("gcc", "rcc", "bcc", "brightness"), "path").alias("v")
    return rows.groupBy(*SITE_YEAR, "annotation_id", "ring", "ts").agg(last).select(*SITE_YEAR, "annotation_id", "ring", "ts", "v.*")


def by_ring(observations: DataFrame, ratios: list[int]) -> DataFrame:
    """One row an observation, columns GCC, RCC, BCC, brightness and the same for each shrunk ring."""
    keys = [*SITE_YEAR, "annotation_id", "ts"]
    columns = [F.max(F.when(F.col("ring") == ring, F.col(c))).alias(f"{n}{ring}") for ring in ["", *(f"_s{r}" for r in ratios)] for n, c in (("GCC", "gcc"), ("RCC", "rcc"), ("BCC", "bcc"), ("brightness", "brightness"))]
    return observations.groupBy(*keys).agg(*columns)


def run_extraction(spark: SparkSession, cfg: Extraction, mode: str = "normal") -> dict[str, int]:
    """Stage 1 over an archive. Mode "check" works on regions without a file yet; "normal" on site-years without any.

    Writes observations and metadata of each region with a uid, and the regions without one to missing_uids.txt.
    """
    hashes = None
    if cfg.camera_hashes_path is not None:  # folder -> name in the file
        hashes = {v: k for k, v in json.loads(cfg.camera_hashes_path.read_text()).items()}
    polygons = files.read_polygons(spark, str(cfg.polygon_config_path), str(cfg.polygon_files_root), hashes)
    uids = files.read_uids(spark, str(cfg.uid_mapping_path))
    named = with_uids(polygons, uids)
    done = files.completed(spark, str(cfg.output_root), "_raw-cc-data.csv")
    todo = files.pending(named, done) if mode == "check" else files.pending(named, done.select(*SITE_YEAR).distinct(), keys=SITE_YEAR)
    missing = without_uid(named)
    rings = kept(regions(todo, cfg.categories_kept, cfg.shrink_ratios))
    # Only folders with work to do are listed and opened, a sample of their files tells the shapes, and each is decoded once.
    folders = files.folders(spark, str(cfg.image_dataset_root), rings)
    listed = files.list_pictures(spark, str(cfg.image_dataset_root), folders)
    shapes = kept(filters.modal_shape(files.with_shapes(filters.strided(listed, SITE_YEAR)), SITE_YEAR, sample=None))
    pictures = files.read_pictures(spark, str(cfg.image_dataset_root), folders)
    wide = kept(by_ring(extract(pictures, rings, shapes), cfg.shrink_ratios).join(uids, "annotation_id"))
    columns = [f"{c}{s}" for s in ["", *(f"_s{r}" for r in cfg.shrink_ratios)] for c in ("GCC", "RCC", "BCC", "brightness")]
    n = files.write_observations(wide, columns, str(cfg.output_root))
    quality = sampling.sampling_flags(wide, [*KEYS, "annotation_id"]).drop(*[f"{s}_{m}" for s in sampling.SEASONS for m in ("coverage_ratio", "avg_obs_per_day", "n_gaps", "max_gap_days", "max_consecutive_missing_days")])
    base = rings.where("ring = ''").drop("ring", "uid")
    for r in cfg.shrink_ratios:
        base = base.join(rings.where(F.col("ring") == f"_s{r}").select(*SITE_YEAR, "annotation_id", F.col("coords").alias(f"coords_s{r}"), F.col("area").alias(f"area_s{r}")), [*SITE_YEAR, "annotation_id"], "left")
    meta = base.join(quality, [*SITE_YEAR, "annotation_id"]).withColumn("full_name", F.concat_ws("_", "uid", "year")).withColumn("unique_id", F.col("uid"))
    meta = meta.withColumn("date_processed", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).withColumn("sub_location", F.col("sublocation"))
    text = F.to_json(F.struct(*[c for c in meta.columns if c not in ("uid", "sublocation")]), {"ignoreNullFields": "false"})
    files.write_files(meta.select(files.tree_path("_metadata.json").alias("path"), text.alias("body")), str(cfg.output_root))
    files.write_lines(missing, f"{cfg.output_root}/missing_uids.txt")
    return {"units": n, "missing_uids": missing.count()}


def with_uids(regions_: DataFrame, uids: DataFrame, key: str = "annotation_id") -> DataFrame:
    """Every region with its ``uid``, null where ``uids`` (``key, uid``, each key once) doesn't have it."""
    return regions_.join(uids.select(key, "uid"), key, "left")


def without_uid(regions_: DataFrame) -> DataFrame:
    """``line``: site, year and annotation of the regions that have no uid."""
    return regions_.where(F.col("uid").isNull()).select(F.concat_ws("/", F.concat_ws("_", "location", "sublocation"), "year", "annotation_id").alias("line")).distinct()


def plot_overlays(spark: SparkSession, cfg: Extraction, fraction: float = 0.6) -> int:
    """One picture of each site-year (that at a fraction of its sorted ones) with its regions, as PNG below ``plot_dir``."""
    from ..functions.overlay import draw, png
    from ..operators.analytics import row_at_fraction

    ship(spark)
    polygons = files.read_polygons(spark, str(cfg.polygon_config_path), str(cfg.polygon_files_root))
    regions_of = polygons.groupBy(*SITE_YEAR).agg(F.collect_list(F.struct("category", "coords")).alias("rois"))
    folders = files.folders(spark, str(cfg.image_dataset_root), polygons)
    listed = files.with_shapes(files.list_pictures(spark, str(cfg.image_dataset_root), folders))
    chosen = kept(row_at_fraction(listed.select(*SITE_YEAR, "path"), SITE_YEAR, "path", fraction))
    pictures = files.read_pictures(spark, str(cfg.image_dataset_root), folders)
    rows = pictures.join(chosen, [*SITE_YEAR, "path"], "left_semi").join(regions_of, SITE_YEAR)

    def drawn(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            bodies = []
            for r in batch.itertuples(index=False):
                picture = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3).copy()
                bodies.append(png(draw(picture, [(x["category"], [list(p) for p in x["coords"]]) for x in r.rois])))
            yield pd.DataFrame({"path": [f"{r.location}_{r.sublocation}-{r.year}.png" for r in batch.itertuples(index=False)], "body": bodies})

    return files.write_files(rows.select(*SITE_YEAR, "height", "width", "data", "rois").mapInPandas(drawn, "path string, body binary"), str(cfg.plot_dir))


# Stage 2


def process(observations: DataFrame, cfg: Processing, snow: DataFrame | None = None) -> dict[str, DataFrame]:
    """Products, smoothed products, sampling flags and status of all units.

    Order: brightness, snow, step detector, noon, flags, then each channel's non-null values to products. ``product``
    and ``smoothed`` are long: ``keys, channel, window, strategy, date, doy, value`` and ``smoothed``.
    """
    chosen = files.channel_columns(cfg.shrink_suffix)
    brightness = f"brightness_s{cfg.shrink_suffix}" if cfg.shrink_suffix else "brightness"
    # What a unit has is what its own file has.
    has = lambda c: F.array_contains("header", c) if "header" in observations.columns else F.lit(c in observations.columns)
    rows = filters.exclude_locations(observations, cfg.exclude_locations)
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in [brightness, *chosen.values()] if c not in rows.columns})
    some = reduce(Column.__or__, [has(n) for n in chosen.values()])
    units = rows.groupBy(*KEYS).agg(F.max(has(brightness)).alias("light"), F.max(some).alias("some"), F.max(F.col(brightness).between(cfg.brightness_min, cfg.brightness_max) & ~F.isnan(brightness)).alias("bright"))
    of = F.when(~F.col("light"), "no-brightness-col").when(~F.coalesce("bright", F.lit(False)), "empty-after-brightness").when(~F.col("some"), "no-matching-channels").otherwise("done")
    status = units.select(*KEYS, of.alias("status"))
    bright = filters.brightness_filter(rows.where(some), brightness, cfg.brightness_min, cfg.brightness_max).withColumn("selected", F.map_from_entries(F.filter(F.array(*[F.when(has(n), F.struct(F.lit(c).alias("k"), F.lit(n).alias("v"))) for c, n in chosen.items()]), lambda e: e.isNotNull())))
    rows = filters.mask_snow(bright, snow, [brightness, *chosen.values()]) if snow is not None else bright
    steps = sampling.step_detector(rows, KEYS)
    if cfg.noon_only_on_resolution_change:
        rows = sampling.noon_where_stepped(rows, steps, KEYS)
    flags = sampling.sampling_flags(rows, KEYS).join(steps.select(*KEYS, F.col("detected").alias("resolution_change_detected"), F.col("best_doy").alias("resolution_change_doy")), KEYS, "left")
    flags = flags.withColumn("resolution_change_detected", F.coalesce("resolution_change_detected", F.lit(False)))
    flags = flags.withColumn("noon_only_applied", F.col("resolution_change_detected") & F.lit(cfg.noon_only_on_resolution_change))
    flags = flags.withColumn("noon_only_gate_config", F.lit(cfg.noon_only_on_resolution_change)).withColumn("shrink_suffix", F.lit(cfg.shrink_suffix))
    flags = flags.join(rows.groupBy(*KEYS).agg(F.any_value("selected").alias("column_selected")), KEYS)
    long = rows.select(*KEYS, "ts", *[F.col(n).alias(c) for c, n in chosen.items()]).unpivot([*KEYS, "ts"], list(chosen), "channel", "value").where(F.col("value").isNotNull())
    keys = [*KEYS, "channel"]
    parts, strategies = [], tuple(cfg.aggregation_strategies)
    for window in cfg.aggregation_windows:
        days = int(window.rstrip("D"))
        made = resample.long_product(resample.product(long, keys, window, strategies=strategies), keys, strategies).withColumn("window", F.lit(window))
        candidates = [w for w in cfg.smoothing_window_candidates if w <= smooth.window_limit(days)]
        series = [*keys, "window", "strategy"]
        parts.append(smooth.cv_smooth(made, series, "value", candidates, cfg.smoothing_cv_kfolds, longest=smooth.LONGEST) if candidates else made.withColumn("best", F.lit(None).cast("int")).withColumn("smoothed", F.lit(None).cast("double")))
    product = reduce(DataFrame.unionByName, parts)
    return {"product": product, "flags": flags, "status": status}


def run_processing(spark: SparkSession, cfg: Processing, force: bool = False) -> DataFrame:
    """Stage 2 over a dataset's files; units whose flags are written and of the same settings are skipped. Returns the status."""
    suffixes = (None, cfg.shrink_suffix) if cfg.shrink_suffix else (None,)
    rows = files.read_observations(spark, str(cfg.input_root), suffixes)
    done = files.completed(spark, str(cfg.output_root), "-sampling-flags.json")
    if not force and not done.isEmpty():
        same = (F.col("fields")["noon_only_gate_config"] == str(cfg.noon_only_on_resolution_change).lower()) & F.col("fields")["shrink_suffix"].eqNullSafe(F.lit(cfg.shrink_suffix))
        done = files.read_json_maps(spark, str(cfg.output_root), "-sampling-flags.json").where(same).select(*KEYS)
    todo = kept(files.pending(rows, done, force))
    skipped = kept(rows.select(*KEYS).distinct().join(todo.select(*KEYS).distinct(), KEYS, "left_anti").withColumn("status", F.lit("skip")))
    snow = files.read_snow(spark, str(cfg.snow_flags_root)) if cfg.snow_flags_root else None
    out = process(todo, cfg, snow)
    write_products(kept(out["product"]), cfg.aggregation_strategies, str(cfg.output_root))
    flags = out["flags"]
    text = F.to_json(F.struct(*[c for c in flags.columns if c not in KEYS]), {"ignoreNullFields": "false"})
    files.write_files(flags.select(files.tree_path("-sampling-flags.json").alias("path"), text.alias("body")), str(cfg.output_root))
    return out["status"].unionByName(skipped)


def write_products(product: DataFrame, strategies: list[str], root: str) -> int:
    """Product and smoothed files of ``keys, channel, window, strategy, date, value, best, smoothed``; returns their number.

    A smoothed file has the columns of the strategies for which a width was selected, and isn't written where there is none.
    Files are dealt to a stated number of tasks, as few bytes make much work here.
    """
    series, n = [*KEYS, "channel", "window"], 0
    for kind, value in (("product", "value"), ("smoothed", "smoothed")):
        rows = product if kind == "product" else product.where(F.col("best").isNotNull())
        cells = F.array(*[F.max(F.when(F.col("strategy") == s, F.coalesce(F.col(value).cast("string"), F.lit("")))) for s in strategies])
        wide = rows.groupBy(*series, "date").agg(F.filter(F.array(*[F.max(F.when(F.col("strategy") == s, F.lit(s))) for s in strategies]), lambda x: x.isNotNull()).alias("names"), F.filter(cells, lambda x: x.isNotNull()).alias("cells"))
        line = F.concat_ws(",", F.col("date").cast("string"), F.array_join("cells", ","))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("date", line.alias("l")))), lambda r: r["l"])
        body = F.concat(F.lit("date,"), F.array_join(F.any_value("names"), ","), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
        ending = F.concat(F.lit("-"), F.col("channel"), F.lit("-"), F.col("window"), F.lit(f"-{kind}.csv"))
        bodies = wide.groupBy(*series).agg(body.alias("body")).select(files.tree_path(ending).alias("path"), "body")
        n += files.write_files(bodies.repartition(max(files.WRITERS, bodies.sparkSession.sparkContext.defaultParallelism), "path"), root)
    return n


# Stage 3


def estimate(product: DataFrame, cfg: Modelling, keys: list[str] | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """One row a series with ``status``: dates and uncertainties (maps), amplitude, baseline, peak, window, noise, SNR, cycles.

    ``product`` has ``keys, date, doy`` and the strategy's column, and from files the ``header`` of each. A series' number
    among all sorted ones seeds its noise; ``numbers`` gives these where ``product`` doesn't hold all. The smoothed series,
    which every part reads, are made once and kept; where none can be smoothed there is only the status.
    """
    keys = keys or KEYS
    value = str(cfg.series_strategy)
    if value not in product.columns:
        return product.select(*keys).distinct().withColumn("status", F.lit("missing-strategy"))
    has = F.array_contains("header", value) if "header" in product.columns else F.lit(True)
    rows = product.select(*keys, "date", "doy", value, has.alias("_has"))
    candidates = cfg.candidates()
    if not candidates:
        return rows.groupBy(*keys).agg(F.when(F.max("_has"), "cv-no-candidates").otherwise("missing-strategy").alias("status"))
    smoothed = kept(smooth.cv_smooth(rows, keys, value, candidates, cfg.cv_kfolds, cfg.cv_random_state, longest=smooth.LONGEST))  # a series is a year
    units = smoothed.groupBy(*keys).agg(F.max("_has").alias("_has"), F.count(value).alias("_n"), F.max("best").alias("window_selected"))
    failed = F.when(~F.col("_has"), "missing-strategy").when(F.col("_n") < cfg.cv_kfolds, "too-short").when(F.col("window_selected").isNull(), "cv-failed")
    usable = smoothed.where(F.col("best").isNotNull())
    if usable.isEmpty():
        return units.select(*keys, failed.alias("status"))
    prefix, marks = str(cfg.series_index)[0], tuple(cfg.amplitude_thresholds)
    found = transitions.transitions(usable, keys, prefix, thresholds=marks, low=cfg.doy_min, high=cfg.doy_max)
    quality = transitions.signal_quality(usable, keys, value, "smoothed")
    peaks = transitions.cycles(usable, keys, "smoothed", found.select(*keys, "amplitude"))
    spread = montecarlo.uncertainties(smoothed, keys, value, "smoothed", candidates, cfg.random_seed, cfg.mc_iterations, cfg.cv_kfolds, marks, cfg.doy_min, cfg.doy_max, prefix, numbers=numbers)
    names = [c for c in spread.columns if c.endswith("_std") and c != "noise_std"]
    spread = spread.select(*keys, F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("uncertainties"))
    out = units.join(found, keys, "left").join(spread, keys, "left").join(quality, keys, "left").join(peaks, keys, "left")
    status = failed.when(F.col("amplitude").isNull(), "no-season-data").otherwise("done")
    return out.select(*keys, status.alias("status"), "dates", "amplitude", "baseline", "peak_value", "uncertainties", "window_selected", "noise_std", "snr", "n_peak")


def run_modelling(spark: SparkSession, cfg: Modelling, force: bool = False) -> DataFrame:
    """Stage 3 over a dataset's files, for each pair of index and window; returns ``keys, series, status``.

    The files of a pair are read once; where all of its units are done, nothing is estimated.
    """
    parts = []
    for one in cfg.combinations():
        series = f"{one.series_index}-{one.series_window}-{one.series_strategy}"
        product = files.read_product(spark, str(cfg.input_root), str(one.series_index), str(one.series_window))
        product = kept(product.select(*[c for c in product.columns if c not in resample.STRATEGIES or c == str(one.series_strategy)]))
        done = files.completed(spark, str(cfg.output_root), f"-{series}-transitions.json")
        todo = files.pending(product, done, force)
        if not force:
            parts.append(product.select(*KEYS).distinct().join(done, KEYS, "left_semi").select(*KEYS, F.lit(series).alias("series"), F.lit("skip").alias("status")))
            if todo.isEmpty():
                continue
        numbers = montecarlo.series_numbers(product, KEYS)  # of all units, so that what is done doesn't change the others' noise
        found = kept(estimate(todo, one, numbers=numbers))
        if "dates" not in found.columns:
            parts.append(found.select(*KEYS, F.lit(series).alias("series"), "status"))
            continue
        text = F.to_json(F.struct("dates", "amplitude", "baseline", "peak_value", "uncertainties", "window_selected", "noise_std", "snr", "n_peak"), {"ignoreNullFields": "false"})
        text = F.regexp_replace(text, r':"(NaN|-?Infinity)"', ":$1")  # bare, as other programs write and read them
        files.write_files(found.where("status = 'done'").select(files.tree_path(f"-{series}-transitions.json").alias("path"), text.alias("body")), str(cfg.output_root))
        parts.append(found.select(*KEYS, F.lit(series).alias("series"), "status"))
    return reduce(DataFrame.unionByName, parts)


# Stage 4

# The fields of a region that a record begins with, after where and when it is; fields that are lists.
_IDENTITY = ["full_name", "annotation_id", "name", "category", "genus", "species", "area", "area_s33"]
_LISTS = ["gap_start_dates", "gap_lengths_day"]
# The scalars of a transitions file.
_SCALARS = ["amplitude", "baseline", "peak_value", "window_selected", "noise_std", "snr", "n_peak"]


def _number(value: Column) -> Column:
    """A JSON scalar as a number: booleans are 1 and 0, NaN and infinities stay; text is none, whatever it looks like."""
    kind = F.schema_of_variant(value)
    return F.when(~kind.isin("STRING", "VOID"), F.try_variant_get(value, "$", "double"))


def _text(value: Column) -> Column:
    """A JSON value as it stands in the table: True and False, text without quotes, numbers as written, objects as JSON."""
    plain = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(plain)).when(F.lower(plain) != "nan", plain)


def collect_records(spark: SparkSession, root: str) -> DataFrame:
    """Identity columns, ``metrics`` and ``flags`` of every unit with flags and metadata; transitions where there are any.

    ``metrics`` (numbers) is what rules judge: the flags, too, as far as they are numbers or booleans (text is null).
    ``flags`` (text) is what is written of them.
    """
    flags = files.read_json_maps(spark, root, "-sampling-flags.json", "map<string,variant>")
    meta = files.read_json_maps(spark, root, "_metadata.json")
    identity = meta.select(*KEYS, *[F.col("fields")[c].alias(c) for c in _IDENTITY])
    kept_ = F.map_filter("fields", lambda k, _: ~k.isin(*_LISTS))
    plain = flags.select(*KEYS, F.explode(kept_).alias("metric", "_v")).select(*KEYS, "metric", _number(F.col("_v")).alias("value"))
    done = files.read_json_maps(spark, root, "-transitions.json", "map<string,variant>")
    stem = F.regexp_replace("file", r"\.json$", "")
    done = done.withColumn("prefix", X.product_prefix(stem, F.concat_ws("_", "uid", "year"))).where(F.col("prefix").isNotNull())
    nested = [F.coalesce(F.try_variant_get(F.try_element_at("fields", F.lit(c)), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")) for c in ("dates", "uncertainties")]
    scalars = F.map_filter("fields", lambda k, _: k.isin(*_SCALARS))
    every = F.concat(*[F.map_entries(m) for m in (nested[0], F.transform_keys(nested[1], lambda k, _: X.deviation_key(k)), scalars)])
    products = done.select(*KEYS, "prefix", F.explode(every).alias("e")).select(*KEYS, F.concat_ws("-", "prefix", "e.key").alias("metric"), _number(F.col("e.value")).alias("value"))
    metrics = records.with_defaults(records.gather(plain.unionByName(products), KEYS))
    return identity.join(metrics, KEYS).join(flags.select(*KEYS, with_default_flags(F.transform_values(kept_, lambda _, v: _text(v))).alias("flags")), KEYS)


def with_default_flags(flags: Column) -> Column:
    """The text of flags, with that of the defaults of absent ones."""
    absent = F.create_map(*[x for k, v in records.FLAG_DEFAULTS.items() for x in (F.lit(k), F.lit(None if v is None else str(bool(v))).cast("string"))])
    return F.map_concat(flags, F.map_filter(absent, lambda k, _: ~F.map_contains_key(flags, k)))


def record_columns(flags: list[str], metrics: list[str]) -> tuple[list[str], list[str]]:
    """The columns of flags and of metrics, in the order of the table: flags as they are written, then product by product
    dates, deviations and scalars, then the season's length."""
    seasonal = [f"{s}_{m}" for s in sampling.SEASONS for m in ("coverage_ratio", "avg_obs_per_day", "n_gaps", "max_gap_days", "max_consecutive_missing_days")]
    first = ["start_date", "end_date", "avg_obs_per_day", "max_obs_per_day", "min_obs_per_day", "n_gaps", *seasonal, *records.FLAG_DEFAULTS, "shrink_suffix", "column_selected"]
    known = {k: i for i, k in enumerate(first)}

    def place(name: str) -> tuple:
        prefix, _, rest = name.partition("-")
        mark = re.match(r"[A-Z]([UD])_(\d+)", rest)
        kind, order = (2, (_SCALARS.index(rest), False)) if rest in _SCALARS else (int(rest.endswith("-std")), (int(mark[2]), mark[1] == "D") if mark else (-1, False))
        return name == records.SEASON_LENGTH[0], prefix, kind, order, name

    return sorted(flags, key=lambda k: (known.get(k, len(known)), k)), sorted(set(metrics) - set(flags), key=place)


def verdicts(judged: DataFrame, rules: records.Rules) -> DataFrame:
    """``line``: what became of each series, and the rules that it breaks."""
    labels = F.array(*map(F.lit, records.rule_labels(rules))).cast("array<string>")
    broken = F.array_join(F.filter(labels, lambda _, i: F.get("failed", i)), "; ")
    part = F.when(~F.col("spring_ok"), "accepted, spring removed").when(~F.col("autumn_ok"), "accepted, autumn removed").otherwise("accepted")
    kind = F.when(F.col("by_list"), "excluded by list").when(F.col("dropped"), "excluded").otherwise(part)
    return judged.orderBy(*KEYS).select(F.concat_ws(": ", F.concat_ws("_", "uid", "year"), kind, F.nullif(broken, F.lit(""))).alias("line"))


def run_aggregation(spark: SparkSession, cfg: Aggregation, verbose: bool = False) -> tuple[DataFrame, str]:
    """Stage 4: the filtered records as one CSV file, and the report beside it; with ``verbose``, a line for each series in the log."""
    found = filters.exclude_locations(collect_records(spark, str(cfg.input_root)), cfg.exclude_locations)
    rules = cfg.rules()
    listed = None
    if cfg.exclude_csv_path is not None:
        listed = files.read_exclusions(spark, str(cfg.exclude_csv_path)).withColumn("year", F.col("year").cast("string"))
    judged = kept(records.judged(found, rules, listed))
    report = records.report(records.counts(judged, rules).first().asDict(), rules)
    if verbose:
        for row in verdicts(judged, rules).toLocalIterator():  # a partition at a time
            log.info("%s", row.line)
    wide = record_table(records.filtered(judged))
    out = cfg.output_path
    files.write_table(wide, str(out), ["location", "sublocation", "year", "full_name"])
    files.write_text(spark, str(out.parent / f"{out.stem}-filtering-report.txt"), report)
    return wide, report


def record_table(passed: DataFrame) -> DataFrame:
    """Records as they are written: where and when, identity, flags as text, then metrics as numbers (NaN is null)."""
    distinct = lambda c: [r.k for r in passed.select(F.explode(F.map_keys(c)).alias("k")).distinct().collect()]  # noqa: E731  (bounded by the settings)
    flags, metrics = record_columns(distinct("flags"), distinct("metrics"))
    flagged = [F.try_element_at("flags", F.lit(f)).alias(f) for f in flags]
    return records.widen(passed.select("*", *flagged), metrics, ["location", "sublocation", "year", *_IDENTITY, *flags], nan_as_null=True)
