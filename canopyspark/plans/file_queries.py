"""Queries over files in the dataset's layout, pictures and polygons, all made from the general tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.geometry import mask_pixels
from ..operators import analytics, montecarlo, records, resample, sampling, smooth
from ..session import dealt, scratch
from ..sources import files
from ..sources.files import KEYS
from . import stages
from . import standins as S
from .catalog import _AGREE, _FLAGS, _PAIRS, _RULES, ORACLES, _records, query
from .config import Extraction, Modelling, Processing
from .standins import BINS_SQL, RECORDS_SQL, TREE_SQL

# Units: a series is a tree of one of four sites.
_PLACE_SQL = "(uid % 4)::VARCHAR AS location, '1' AS sublocation, uid::VARCHAR AS uid, year::VARCHAR AS year"


def _units(df: DataFrame) -> DataFrame:
    """Series with the keys of files: location, sublocation, uid and year, all text."""
    place = (F.col("uid") % 4).cast("string")
    return df.withColumns({"location": place, "sublocation": F.lit("1"), "uid": F.col("uid").cast("string"), "year": F.col("year").cast("string")})


def _smoothed(spark, sf) -> DataFrame:
    """Products of two strategies, each smoothed over three bins; there is no smoothed "avg" for odd trees."""
    long = resample.long_product(resample.binned_product(_units(S.tree_years(spark, sf)), KEYS, strategies=("avg", "p90")), KEYS, ("avg", "p90"))
    long = smooth.rolling_mean(long, [*KEYS, "strategy"], "value", 3, "doy")
    best = F.when((F.col("strategy") == "p90") | (F.col("uid").cast("int") % 2 == 0), 3)
    return long.withColumns({"channel": F.lit("GCC"), "window": F.lit("3D"), "best": best})


@query(f"WITH {BINS_SQL} SELECT {_PLACE_SQL}, doy::BIGINT AS doy, round(avg, 6) AS avg, NULL::DOUBLE AS p50, round(p90, 6) AS p90 FROM bins")
def product_files(spark, sf):
    """Product files written, found below their root and read by their headers; a strategy that they lack is null."""
    root = scratch(spark)
    stages.write_products(_smoothed(spark, sf), ["avg", "p90"], root)
    return files.read_product(spark, root, "GCC", "3D").select(*KEYS, "doy", "avg", "p50", "p90")


@query(f"""WITH {BINS_SQL}, s AS (SELECT uid, year, doy, avg(avg) OVER w AS avg, avg(p90) OVER w AS p90 FROM bins WINDOW w AS (PARTITION BY uid, year ORDER BY doy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
v AS (SELECT *, coalesce(CASE WHEN uid % 2 = 0 THEN avg END, p90) AS v FROM s), r AS (SELECT *, min(v) OVER (PARTITION BY uid, year) AS lo, max(v) OVER (PARTITION BY uid, year) AS hi FROM v WHERE year >= 1995)
SELECT {_PLACE_SQL}, doy::BIGINT AS doy, round((v - lo) / (hi - lo), 6) AS scaled FROM r""")
def profile_files(spark, sf):
    """Smoothed files: the first of two columns that a file has, of the series that records list, scaled."""
    root = scratch(spark)
    stages.write_products(_smoothed(spark, sf), ["avg", "p90"], root)
    smoothed = files.read_product(spark, root, "GCC", "3D", "smoothed")
    listed = smoothed.where("year >= 1995").select(*KEYS).distinct()
    return analytics.profiles(listed, smoothed, KEYS, ["avg", "p90"])


_SEEN = "SELECT user_id AS uid, year(ts) AS year, date_trunc('minute', ts) AS ts, avg(value) AS g, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL"


@query(f"WITH s AS ({_SEEN}) SELECT {_PLACE_SQL}, ts, round(g, 6) AS \"GCC_s50\", round(n * 100, 6)::DOUBLE AS \"brightness_s50\", NULL::DOUBLE AS \"GCC\" FROM s")
def observation_files(spark, sf):
    """Observations written with two suffixes and read by the second; the plain columns aren't there and are null."""
    seen = S.observations(spark, sf).where("value IS NOT NULL").withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    seen = seen.groupBy("uid", F.year("ts").alias("year"), "ts").agg(F.avg("value").alias("GCC_s50"), (F.count(F.lit(1)) * 100).cast("double").alias("brightness_s50"))
    rows = _units(seen).withColumns({c: F.lit(7.0) for c in ("GCC_s33", "brightness_s33")})
    root = scratch(spark)
    files.write_observations(rows, ["GCC_s33", "brightness_s33", "GCC_s50", "brightness_s50"], root)
    return files.read_observations(spark, root, (None, "50")).select(*KEYS, "ts", "GCC_s50", "brightness_s50", "GCC")


@query(f"""WITH s AS ({_SEEN}), u AS (SELECT uid, year, CASE uid % 3 WHEN 0 THEN 'no-brightness-col' WHEN 1 THEN CASE WHEN max(n * 100) >= 150 THEN 'done' ELSE 'empty-after-brightness' END ELSE CASE WHEN max(n * 100) >= 150 THEN 'no-matching-channels' ELSE 'empty-after-brightness' END END AS status FROM s GROUP BY uid, year)
SELECT {_PLACE_SQL}, status FROM u""")
def unit_status(spark, sf):
    """What becomes of each unit in the second stage: files of some lack the brightness, of others the channels."""
    seen = S.observations(spark, sf).where("value IS NOT NULL").withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    rows = _units(seen.groupBy("uid", F.year("ts").alias("year"), "ts").agg(F.avg("value").alias("GCC"), (F.count(F.lit(1)) * 100).cast("double").alias("brightness")))
    root = scratch(spark)
    kind = F.col("uid").cast("int") % 3
    for i, columns in enumerate((["GCC"], ["brightness", "GCC"], ["brightness"])):
        files.write_observations(rows.where(kind == i), columns, root)
    settings = Processing(Path("."), Path("."), brightness_min=150, brightness_max=10_000, shrink_suffix=None, aggregation_windows=["3D"])
    return stages.process(files.read_observations(spark, root, (None,)), settings)["status"]


@query("""WITH snow AS (SELECT c_nationkey::VARCHAR AS location, o_orderdate::DATE AS date, max((o_orderstatus = 'F')::INT) AS snow FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT location, date, snow::BIGINT AS snow FROM snow""")
def snow_files(spark, sf):
    """Daily flags, a file a location and year, columns in another order than usual."""
    from .catalog import _snow

    flags = _snow(spark, sf).withColumns({"location": F.col("location").cast("string"), "year": F.year("date")})
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "snow"))), lambda r: F.concat_ws(",", r["date"].cast("string"), F.lit("x"), r["snow"].cast("string"))), "\n")
    bodies = flags.groupBy("location", "year").agg(F.concat(F.lit("date,station,snow\n"), lines).alias("body"))
    root = scratch(spark)
    files.write_files(bodies.select(F.concat("location", F.lit("/"), "location", F.lit("-"), "year", F.lit("-daily_snow_flag.csv")).alias("path"), "body"), root)
    return files.read_snow(spark, root)


@query(f"WITH f AS ({_FLAGS}) SELECT uid, year, start_date, avg_obs_per_day, n_gaps, gap_lengths_day, spring_coverage_ratio, autumn_max_gap_days FROM f")
def flag_files(spark, sf):
    """Sampling flags of raw observations as JSON files, read back as maps."""
    flags = sampling.sampling_flags(_units(S.tree_years(spark, sf)), KEYS)
    text = F.to_json(F.struct(*[c for c in flags.columns if c not in KEYS]), {"ignoreNullFields": "false"})
    root = scratch(spark)
    files.write_files(flags.select(files.tree_path("-sampling-flags.json").alias("path"), text.alias("body")), root)
    kinds = {"start_date": "string", "avg_obs_per_day": "double", "n_gaps": "long", "gap_lengths_day": "array<long>", "spring_coverage_ratio": "double", "autumn_max_gap_days": "long"}
    read = files.read_json_maps(spark, root, "-sampling-flags.json")
    found = [F.from_json(F.col("fields")[c], "array<string>").alias(c) if "array" in k else F.col("fields")[c].cast(k).alias(c) for c, k in kinds.items()]
    out = read.select(F.col("uid").cast("long").alias("uid"), F.col("year").cast("long").alias("year"), *found)
    return out.withColumn("gap_lengths_day", F.array_join("gap_lengths_day", ","))


@query(f"""WITH {TREE_SQL}, r AS (SELECT uid, year, 'species ' || uid % 4 AS species, min(doy)::DOUBLE AS gu, max(doy)::DOUBLE AS gd FROM tree WHERE uid % 3 <> 0 GROUP BY ALL)
SELECT {_PLACE_SQL.replace(", uid::VARCHAR AS uid", "")}, uid || '_' || year AS full_name, species, gu::BIGINT::VARCHAR AS n_gaps, CASE WHEN gd > 362 THEN 'True' ELSE 'False' END AS resolution_change_detected, '5' AS quoted, '{{"GCC":"GCC_s33"}}' AS column_selected,
  CASE WHEN uid % 5 <> 0 THEN gu END AS gu_50, CASE WHEN uid % 5 <> 0 THEN gd END AS gd_25, CASE WHEN uid % 5 <> 0 THEN gu / 8 END AS gu_std, CASE WHEN uid % 5 <> 0 THEN gd - gu END AS season_length, gu >= 2 AS gaps_ok, false AS quoted_ok FROM r""")
def record_files(spark, sf):
    """Flags with metadata (some without) and transitions where there are any, gathered to the table of records.

    Numbers, booleans, text and objects stay what they are; text that looks like a number is none to a rule.
    """
    series = S.tree_years(spark, sf).groupBy("uid", "year").agg(F.min("doy").cast("double").alias("gu"), F.max("doy").cast("double").alias("gd"))
    found = _units(series.withColumn("species", F.concat(F.lit("species "), F.col("uid") % 4))).withColumn("full_name", F.concat_ws("_", "uid", "year"))
    number = F.col("uid").cast("int")
    flags = F.struct(F.col("gu").cast("int").alias("n_gaps"), (F.col("gd") > 362).alias("resolution_change_detected"), F.lit("5").alias("quoted"), F.create_map(F.lit("GCC"), F.lit("GCC_s33")).alias("column_selected"), F.array(F.lit(1)).alias("gap_lengths_day"))
    dates = F.struct(F.create_map(F.lit("GU_50"), F.col("gu"), F.lit("GD_25"), F.col("gd")).alias("dates"), F.create_map(F.lit("GU_50_std"), F.col("gu") / 8).alias("uncertainties"))
    root = scratch(spark)
    for rows, ending, value in ((found, "-sampling-flags.json", flags), (found.where(number % 3 != 0), "_metadata.json", F.struct("full_name", "species")), (found.where(number % 5 != 0), "-GCC-3D-p90-transitions.json", dates)):
        files.write_files(rows.select(files.tree_path(ending).alias("path"), F.to_json(value).alias("body")), root)
    judged = records.judged(stages.collect_records(spark, root), records.Rules())
    ok = {"gaps_ok": ~records.fails("n_gaps", 2, True), "quoted_ok": ~records.fails("quoted", 1, True)}
    rules = judged.select("full_name", *[c.alias(n) for n, c in ok.items()])
    names = {"GCC_3D_p90-GU_50": "gu_50", "GCC_3D_p90-GD_25": "gd_25", "GCC_3D_p90-GU_50-std": "gu_std", "GCC_3D_p90-season_length": "season_length"}
    wide = stages.record_table(records.filtered(judged)).withColumnsRenamed(names)
    return wide.select("location", "sublocation", "year", "full_name", "species", "n_gaps", "resolution_change_detected", "quoted", "column_selected", *names.values()).join(rules, "full_name")


@query("WITH u AS (SELECT DISTINCT o_custkey AS uid, year(o_orderdate) AS year FROM orders) SELECT (uid % 4)::VARCHAR AS location, count(*) AS pending FROM u WHERE uid % 3 <> 0 OR year <> 1995 GROUP BY ALL")
def pending_units(spark, sf):
    """Units without a written file, found from the files' paths alone."""
    units = _units(S.table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("year")).distinct()).select(*KEYS)
    root = scratch(spark)
    done = units.where((F.col("uid").cast("int") % 3 == 0) & (F.col("year") == "1995"))
    files.write_files(done.select(files.tree_path("-done.json").alias("path"), F.lit("{}").alias("body")), root)
    return files.pending(units, files.completed(spark, root, "-done.json")).groupBy("location").agg(F.count(F.lit(1)).alias("pending"))


@query("""WITH x AS (SELECT DISTINCT o_custkey::VARCHAR AS uid, year(o_orderdate) AS year FROM orders WHERE o_orderpriority = '1-URGENT') SELECT uid, year::BIGINT AS year FROM x""")
def exclusion_file(spark, sf):
    """The list of units to leave out: two columns of a file that has more, each pair once."""
    listed = S.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("year"), "o_orderstatus")
    path = scratch(spark)
    listed.write.option("header", True).csv(path)
    return files.read_exclusions(spark, path)


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, max(date_trunc('minute', ts)) AS ts FROM events GROUP BY ALL)
SELECT event_type AS location, '1' AS sublocation, year(day)::VARCHAR AS year, ts FROM d WHERE event_type <> 'click'""")
def picture_list(spark, sf):
    """Pictures of the sites that have regions, from their paths alone: other files, and names without a time, are none."""
    days = S.table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max(F.date_trunc("minute", "ts")).alias("ts"))
    folder = F.concat("event_type", F.date_format("day", "/'1'/yyyy/MM/dd/"))
    named = F.array(F.concat(folder, F.date_format("ts", "'cam_'yyyy-MM-dd_HHmm'.jpg'")), F.concat(folder, F.lit("cam.jpg")), F.concat(folder, F.date_format("ts", "'cam_'yyyy-MM-dd_HHmm'.txt'")))
    root = scratch(spark)
    files.write_files(days.select(F.explode(named).alias("path"), F.lit("x").alias("body")), root)
    from ..operators.filters import in_units

    sites = days.where("event_type <> 'click'").select(F.col("event_type").alias("location"), F.lit("1").alias("sublocation"), F.date_format("day", "yyyy").alias("year"))
    return in_units(files.list_pictures(spark, root), sites, stages.SITE_YEAR).select(*stages.SITE_YEAR, "ts")


@query("""WITH p AS (SELECT o_orderkey % 7 AS site, o_orderdate AS ts, o_custkey % 200 AS r, o_orderkey % 150 AS g, o_custkey % 90 AS b FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 7, o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1),
m AS (SELECT *, r + 20 AS r2, g + 10 AS g2, b AS b2 FROM p), a AS (SELECT site, ts, (r + r2) / 2 AS r, (g + g2) / 2 AS g, (b + b2) / 2 AS b FROM m)
SELECT site::VARCHAR AS annotation_id, ts, round(g / greatest(r + g + b, 1e-6), 6) AS "GCC", round(r / greatest(r + g + b, 1e-6), 6) AS "RCC", round(greatest(r + g + b, 1e-6), 6) AS brightness FROM a""")
def picture_ratios(spark, sf):
    """Colour ratios of a square region whose upper half is darker, from pictures as rows of bytes; of one time the last counts."""
    orders = S.table(spark, sf, "orders")
    site = (F.col("o_orderkey") % 7).cast("string")
    colour = lambda more: F.concat(*[F.lpad(F.hex(c + m), 2, "0") for c, m in zip((F.col("o_custkey") % 90, F.col("o_orderkey") % 150, F.col("o_custkey") % 200), more, strict=True)])
    data = F.unhex(F.concat(F.repeat(colour((0, 0, 0)), 7 * 16), F.repeat(colour((0, 10, 20)), 9 * 16)))
    pictures = orders.select(F.lit("s").alias("location"), site.alias("sublocation"), F.lit("1").alias("year"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.lit(16).alias("height"), F.lit(16).alias("width"), data.alias("data"))
    ring = F.lit([[3.0, 2.0], [12.0, 2.0], [12.0, 11.0], [3.0, 11.0]])
    regions = spark.range(7).select(F.lit("s").alias("location"), F.col("id").cast("string").alias("sublocation"), F.lit("1").alias("year"), F.col("id").cast("string").alias("annotation_id"), ring.alias("coords"), F.lit("individual tree").alias("category"))
    wide = stages.by_ring(stages.extract(pictures, stages.regions(regions, ["individual tree"], []), pictures.select(*stages.SITE_YEAR, "height", "width").distinct()), [])
    return wide.select("annotation_id", F.col("ts").cast("timestamp").cast("timestamp_ntz").alias("ts"), "GCC", "RCC", "brightness")


@query("SELECT p_partkey, round(a, 6) AS area, round(a * 33 / 100, 6) AS area_s33, w::DOUBLE AS polygon_width FROM (SELECT p_partkey, (p_size + 4) * (p_partkey % 9 + 3) AS a, p_size + 4 AS w FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))")
def shrunk_regions(spark, sf):
    """Regions of two categories and their rings of a third of the area."""
    w, h = (F.col("p_size") + 4).cast("double"), (F.col("p_partkey") % 9 + 3).cast("double")
    zero = F.lit(0.0)
    ring = F.array(F.array(zero, zero), F.array(w, zero), F.array(w, h), F.array(zero, h))
    polygons = S.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"), ring.alias("coords"))
    rings = stages.regions(polygons, ["ECONOMY", "PROMO"], [33])
    return rings.groupBy("p_partkey").agg(F.max(F.when(F.col("ring") == "", F.col("area"))).alias("area"), F.max(F.when(F.col("ring") == "_s33", F.col("area"))).alias("area_s33"), F.max("polygon_width").alias("polygon_width"))


@query("SELECT p_partkey, ((p_size % 30 + 5) * (p_partkey % 9 + 3))::BIGINT AS pixels, greatest(0, least(40, p_size % 30 + 10) - 5) * greatest(0, least(12, p_partkey % 9 + 7) - 4) AS inside FROM part")
def mask_sizes(spark, sf):
    """Pixels of rectangles, their border included, and of the same ones cut by a smaller picture."""
    w, h = F.col("p_size") % 30 + 4, (F.col("p_partkey") % 9 + 2).cast("int")
    x, y = F.lit(5.9), F.lit(4.2)
    ring = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    size = lambda height, width: F.size(mask_pixels(ring, F.lit(height), F.lit(width))).cast("long")
    return dealt(S.table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", size(100, 100).alias("pixels"), size(12, 40).alias("inside"))


@query("""WITH a AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'h' || n_nationkey ELSE (1000 + n_nationkey)::VARCHAR END AS location, CASE WHEN n_nationkey % 5 = 0 THEN '1' ELSE '2' END AS sublocation, s_suppkey, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0)
SELECT location, sublocation, '2020' AS year, 'a' || s_suppkey AS annotation_id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'u' || s_suppkey END AS uid, CASE WHEN s_suppkey % 3 = 0 THEN location || '_' || sublocation || '/2020/a' || s_suppkey END AS line FROM a""")
def polygon_files(spark, sf):
    """Regions of a polygon file a site (some files are missing, some sites renamed), with their uids, and the lines of those without."""
    suppliers = S.table(spark, sf, "supplier")
    roi = F.struct(F.col("s_name").alias("name"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("coords"), F.lit("c").alias("category"))
    entry = lambda: F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("a"), "s_suppkey").alias("k"), roi.alias("v"))))
    bodies = suppliers.where("s_nationkey % 4 <> 0").groupBy("s_nationkey").agg(F.to_json(entry()).alias("body")).select(F.concat(F.lit("p"), "s_nationkey", F.lit(".json")).alias("path"), "body")
    root = scratch(spark)
    files.write_files(bodies, f"{root}/polygons")
    key = F.col("n_nationkey")
    site = F.when(key % 5 == 0, F.concat(F.lit("hill "), key)).otherwise(F.concat((1000 + key).cast("string"), F.lit("_2")))
    listed = S.table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(site.alias("k"), F.create_map(F.lit("2020"), F.concat(F.lit("p"), key, F.lit(".json"))).alias("v"))))).alias("body"))
    uids = suppliers.where("s_suppkey % 3 <> 0").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("a"), "s_suppkey").alias("k"), F.concat(F.lit("u"), "s_suppkey").alias("v"))))).alias("body"))
    files.write_files(listed.select(F.lit("sites.json").alias("path"), "body").unionByName(uids.select(F.lit("uids.json").alias("path"), "body")), root)
    regions = files.read_polygons(spark, f"{root}/sites.json", f"{root}/polygons", {f"hill {k}": f"h{k}" for k in range(0, 25, 5)})
    named = regions.join(files.read_uids(spark, f"{root}/uids.json"), "annotation_id", "left")
    lines = stages.without_uid(named).withColumn("annotation_id", F.element_at(F.split("line", "/"), -1))
    return named.join(lines, "annotation_id", "left").select("location", "sublocation", "year", "annotation_id", "name", "uid", "line")


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_nationkey * 90 AS metres FROM nation WHERE n_nationkey <> 3),
r AS (SELECT site::VARCHAR AS location, count(*) AS n FROM records GROUP BY ALL)
SELECT location, n, metres::DOUBLE AS elevation, CASE WHEN metres < 600 THEN 'Low' WHEN metres < 1000 THEN 'Mid' END AS elevation_band, CASE location WHEN '1' THEN 'One' ELSE coalesce(name, location) END AS site, 'panorama' AS image_type FROM r LEFT JOIN s ON id = location""")
def site_lookup(spark, sf):
    """Elevation, its band and the site's name for each record's location, from a file; one location isn't listed there."""
    path = scratch(spark)
    nations = S.table(spark, sf, "nation").where("n_nationkey <> 3")
    nations.select(F.col("n_nationkey").alias("ID"), F.concat(F.lit("Country: "), "n_name").alias("Location"), F.lit("x").alias("other"), (F.col("n_nationkey") * 90).alias("Elevation")).write.option("header", True).csv(path)
    found = S.records(spark, sf).groupBy(F.col("site").cast("string").alias("location")).agg(F.count(F.lit(1)).alias("n"))
    return analytics.with_sites(found, files.read_sites(spark, path), {"1": "One"})


@query(f"""WITH {RECORDS_SQL}, w AS (SELECT 'BUILDING' AS species, year(o_orderdate) AS year, b AS band, avg(dayofyear(o_orderdate)) AS spn FROM orders CROSS JOIN (VALUES ('Low'), ('Mid'), ('High'), ('Very High')) v(b) WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
m AS (SELECT species, year, band, avg(gu) AS gu, avg((gu + gd) / 2) AS peak FROM records WHERE species = 'BUILDING' GROUP BY ALL HAVING count(*) > 5),
p AS (SELECT t AS threshold, CASE t WHEN 'gu' THEN gu ELSE peak END AS y, spn AS x FROM m JOIN w USING (species, year, band) CROSS JOIN (VALUES ('gu'), ('peak')) a(t))
SELECT threshold, count(*) AS n, round(regr_r2(y, x), 6) AS r2, round(avg(y - x), 6) AS bias, round(sqrt(avg((y - x) ** 2)), 6) AS rmse FROM p GROUP BY ALL""")
def network_of_one_species(spark, sf):
    """One species' spring dates and peak against the network's means, which come from a file."""
    path = scratch(spark)
    seen = S.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg(F.dayofyear("o_orderdate")).alias("spn_up"))
    bands = F.explode(F.array(*[F.lit(b) for b in ("Low", "Mid", "High", "Very High")]))
    seen.select(F.lit("BUILDING").alias("species"), "year", bands.alias("elevation_band"), "spn_up", F.lit(None).cast("double").alias("spn_down")).write.option("header", True).csv(path)
    network = files.read_network(spark, path).withColumnRenamed("elevation_band", "band")
    ours = S.records(spark, sf).where("species = 'BUILDING'").withColumn("peak", (F.col("gu") + F.col("gd")) / 2)
    return analytics.network_validation(ours, network, ["species", "year", "band"], ["gu", "peak"], "spn_up").select("threshold", "n", "r2", "bias", "rmse")


@query("WITH u AS (SELECT DISTINCT o_custkey AS uid, year(o_orderdate) AS year FROM orders) SELECT uid, year::BIGINT AS year, row_number() OVER (ORDER BY uid, year) - 1 AS unit FROM u")
def series_numbers(spark, sf):
    """The place of each unit in the order of all, which seeds its noise."""
    units = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("year"))
    return montecarlo.series_numbers(units, ["uid", "year"])


@query("""SELECT p_partkey, 'Tree' || p_partkey AS uid, split_part('s' || p_size || '_1-2', '-', 1) AS site, p_size::VARCHAR || '_1-' || p_partkey AS key, round_even(p_retailprice / 8, 2) AS half, 'GD_' || (p_size % 99)::VARCHAR AS date_key,
p_partkey % 256 AS blue, p_size AS red FROM part""")
def more_names(spark, sf):
    parts = S.table(spark, sf, "part")
    place = X.split_site_year(F.concat(F.lit("s"), F.col("p_size").cast("string"), F.lit("_1-2")))
    colour = X.hex_to_bgr(F.concat(F.lit("#"), F.lpad(F.hex("p_size"), 2, "0"), F.lit("00"), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0")))
    return parts.select("p_partkey", X.uid_of(F.concat(F.lit("Tree"), F.col("p_partkey").cast("string"), F.lit("_2020"))).alias("uid"), F.concat_ws("_", place[0], place[1]).alias("site"),
                        X.site_year(F.col("p_size").cast("string"), F.lit("1"), F.col("p_partkey")).alias("key"), X.half_even(F.col("p_retailprice") / 8, 2).alias("half"),
                        X.date_key(F.lit("G"), "D", (F.col("p_size") % 99) / 100).alias("date_key"), colour[0].alias("blue"), colour[2].alias("red"))


@query(f"WITH {TREE_SQL}, u AS (SELECT uid, year, count(DISTINCT doy) AS n FROM tree WHERE doy BETWEEN 60 AND 160 GROUP BY ALL) SELECT uid::BIGINT AS uid, year::BIGINT AS year, round(n / 101::DOUBLE, 6) AS share FROM u WHERE n > 1")
def spring_coverage(spark, sf):
    flags = sampling.sampling_flags(S.tree_years(spark, sf), S.TREE, seasons={"spring": (60, 160)})
    return flags.select(*S.TREE, F.col("spring_coverage_ratio").alias("share")).where("share > 0")


# Rings that aren't rectangles


@query("""WITH p AS (SELECT p_partkey, (p_size + 4)::DOUBLE AS a, 5 - 8 * sin(pi() / 32) AS k FROM part), d AS (SELECT *, (8 * a - sqrt(64 * a * a - 12 * k * a * a * (1 - 0.33))) / (2 * k) AS d FROM p)
SELECT p_partkey, round(0.33 * 3 * a * a, 6) AS area_s33, round(2 * a - 2 * d, 6) AS width_s33, round(2 * a - 2 * d, 6) AS height_s33 FROM d""")
def shrunk_corners(spark, sf):
    """Rings with a corner that points inwards: three squares of four; the circle around it goes in 16 chords."""
    a, zero = (F.col("p_size") + 4).cast("double"), F.lit(0.0)
    ring = F.array(*[F.array(x, y) for x, y in ((zero, zero), (2 * a, zero), (2 * a, a), (a, a), (a, 2 * a), (zero, 2 * a))])
    rings = stages.regions(S.table(spark, sf, "part").select("p_partkey", F.lit("tree").alias("category"), ring.alias("coords")), ["tree"], [33])
    return rings.where("ring = '_s33'").select("p_partkey", F.col("area").alias("area_s33"), F.col("polygon_width").alias("width_s33"), F.col("polygon_height").alias("height_s33"))


@query("SELECT p_partkey, (2 * r * r + 2 * r + 1)::BIGINT AS diamond, ((r + 1) * (r + 2) / 2)::BIGINT AS triangle, (3 * r * r + 4 * r + 1)::BIGINT AS corner FROM (SELECT p_partkey, p_size % 20 + 2 AS r FROM part)")
def slanted_masks(spark, sf):
    """Pixels of diamonds, triangles and rings with a corner inwards, their borders included."""
    r = (F.col("p_size") % 20 + 2).cast("double")
    ring = lambda points: F.array(*[F.array(F.lit(30.0) + x, F.lit(30.0) + y) for x, y in points])
    zero = F.lit(0.0)
    shapes = {"diamond": [(r, zero), (zero, r), (-r, zero), (zero, -r)], "triangle": [(zero, zero), (r, zero), (zero, r)], "corner": [(zero, zero), (2 * r, zero), (2 * r, r), (r, r), (r, 2 * r), (zero, 2 * r)]}
    size = lambda points: F.size(mask_pixels(ring(points), F.lit(90), F.lit(90))).cast("long")
    return dealt(S.table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", *[size(p).alias(n) for n, p in shapes.items()])


# Whole stages over files


def _painted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pictures of 24 x 16 pixels in one colour, as PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    for batch in batches:
        head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 24, 16, 8, 2, 0, 0, 0))
        yield pd.DataFrame({"path": batch.path, "body": [head + chunk(b"IDAT", zlib.compress((b"\0" + bytes([r, g, b]) * 24) * 16)) + chunk(b"IEND", b"") for r, g, b in zip(batch.r, batch.g, batch.b, strict=True)]})


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, max(date_trunc('minute', ts)) AS ts, count(*) AS n, max(user_id) AS u FROM events GROUP BY ALL),
p AS (SELECT *, n % 200 + 20 AS r, u % 150 + 30 AS g, (n + u) % 90 AS b FROM d WHERE day <> DATE '2024-01-09'),
s AS (SELECT event_type, day, ts, g / (r + g + b) AS gcc, r + g + b AS light, dayofyear(day) - lag(dayofyear(day)) OVER (PARTITION BY event_type ORDER BY ts) AS step FROM p)
SELECT event_type AS location, 'u_' || event_type AS uid, count(*) AS n, round(avg(gcc), 6) AS gcc, round(avg(gcc), 6) AS gcc_s33, round(avg(light), 6) AS brightness, 80.0::DOUBLE AS area, 26.4::DOUBLE AS area_s33, 10.0::DOUBLE AS polygon_width,
  strftime(min(day), '%Y-%m-%d') AS start_date, strftime(max(day), '%Y-%m-%d') AS end_date, count(*) FILTER (step > 1) AS n_gaps, event_type || '_1/2024/b_' || event_type AS missing FROM s WHERE event_type <> 'click' GROUP BY event_type""")
def extracted_files(spark, sf):
    """The first stage over files: pictures, polygons and uids written, read, evaluated and written as observations and metadata.

    Of three regions a site one has a uid, one has none, one lies outside the pictures; one site has no regions.
    """
    days = S.table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max(F.date_trunc("minute", "ts")).alias("ts"), F.count(F.lit(1)).alias("n"), F.max("user_id").alias("u")).where("day <> DATE '2024-01-09'")
    path = F.concat("event_type", F.date_format("ts", "'/1/'yyyy/MM/dd/'cam_'yyyy-MM-dd_HHmm'.jpg'"))
    root = scratch(spark)
    painted = days.select(path.alias("path"), (F.col("n") % 200 + 20).alias("r"), (F.col("u") % 150 + 30).alias("g"), ((F.col("n") + F.col("u")) % 90).alias("b"))
    files.write_files(painted.mapInPandas(_painted, "path string, body binary"), f"{root}/images")
    sites = days.where("event_type <> 'click'").select("event_type").distinct()
    ring = lambda x, y: F.lit([[x, y], [x + 10.0, y], [x + 10.0, y + 8.0], [x, y + 8.0]])
    roi = lambda name, place: F.struct(F.concat(F.lit(name), "event_type").alias("k"), F.struct(F.lit("I.1").alias("name"), place.alias("coords"), F.lit("individual tree").alias("category")).alias("v"))
    rois = F.map_from_entries(F.array(roi("a_", ring(4.0, 3.0)), roi("b_", ring(6.0, 5.0)), roi("c_", ring(40.0, 30.0))))
    key = F.concat("event_type", F.lit("_1"))
    files.write_files(sites.select(F.concat("event_type", F.lit(".json")).alias("path"), F.to_json(rois).alias("body")), f"{root}/polygons")
    every = lambda k, v: F.to_json(F.map_from_entries(F.collect_list(F.struct(k.alias("k"), v.alias("v")))))  # noqa: E731  (a row a site)
    config = sites.agg(every(key, F.create_map(F.lit("2024"), F.concat("event_type", F.lit(".json")))).alias("body"))
    named = F.explode(F.array(F.lit("a_"), F.lit("c_"))).alias("of")
    uids = sites.select("event_type", named).agg(every(F.concat("of", "event_type"), F.concat(F.when(F.col("of") == "a_", "u_").otherwise("v_"), "event_type")).alias("body"))
    files.write_files(config.select(F.lit("sites.json").alias("path"), "body").unionByName(uids.select(F.lit("uids.json").alias("path"), "body")), root)
    stages.run_extraction(spark, Extraction(f"{root}/images", f"{root}/out", f"{root}/polygons", f"{root}/sites.json", f"{root}/uids.json"))
    seen = files.read_observations(spark, f"{root}/out").groupBy("location", "uid").agg(F.count("ts").alias("n"), F.avg("GCC").alias("gcc"), F.avg("GCC_s33").alias("gcc_s33"), F.avg("brightness").alias("brightness"))
    kinds = {"area": "double", "area_s33": "double", "polygon_width": "double", "start_date": "string", "end_date": "string", "n_gaps": "long"}
    meta = files.read_json_maps(spark, f"{root}/out", "_metadata.json").select("location", "uid", *[F.col("fields")[c].cast(k).alias(c) for c, k in kinds.items()])
    lines = spark.read.text(f"{root}/out/missing_uids.txt").select(F.regexp_extract("value", "^([^_]+)_", 1).alias("location"), F.col("value").alias("missing"))
    return seen.join(meta, ["location", "uid"]).join(lines, "location")


_FIRST_BINS = "SELECT DISTINCT uid, year FROM bins"


@query(f"""WITH {BINS_SQL}, t AS ({ORACLES["transition_dates"]})
SELECT {_PLACE_SQL}, 'GCC-3D-p90' AS series, 'done' AS status, 'skip' AS again, amplitude, baseline, "PEAK", "GU_50", "GD_50" FROM t
UNION ALL SELECT {_PLACE_SQL}, 'RCC-3D-p90', 'too-short', 'too-short', NULL, NULL, NULL, NULL, NULL FROM ({_FIRST_BINS})""")
def transition_files(spark, sf):
    """The third stage over files of two indices, twice: the dates that the first run wrote, and what became of each series.

    The files of one index are too short; NaN and infinities in the files that are written are read as such.
    """
    bins = _units(resample.binned_product(S.tree_years(spark, sf), S.TREE, strategies=("p90",)))
    long = resample.long_product(bins, KEYS, ("p90",)).withColumn("_i", F.row_number().over(W.partitionBy(*KEYS).orderBy("doy")))
    both = F.when(F.col("_i") <= 3, F.array(F.lit("GCC"), F.lit("RCC"))).otherwise(F.array(F.lit("GCC")))  # the bins are made once for both
    long = long.withColumn("channel", F.explode(both)).drop("_i").withColumns({"window": F.lit("3D"), "best": F.lit(None).cast("int"), "smoothed": F.lit(None).cast("double")})
    root = scratch(spark)
    stages.write_products(long, ["p90"], root)
    settings = Modelling(root, root, random_seed=3, series_index=["GCC", "RCC"], mc_iterations=2)
    status = stages.kept(stages.run_modelling(spark, settings))
    again = stages.run_modelling(spark, settings).withColumnRenamed("status", "again")
    fields = files.read_json_maps(spark, root, "-transitions.json", "map<string,variant>")
    value = lambda path: F.try_variant_get(F.try_element_at("fields", F.lit(path.split(".")[0])), "$" + "".join(f".{x}" for x in path.split(".")[1:]), "double").alias(path.split(".")[-1])
    stem = F.concat(F.concat_ws("_", "uid", "year"), F.lit("-"))
    found = fields.select(*KEYS, F.replace(F.regexp_replace("file", r"-transitions\.json$", ""), stem, F.lit("")).alias("series"), *map(value, ("amplitude", "baseline", "dates.PEAK", "dates.GU_50", "dates.GD_50")))
    return status.join(again, [*KEYS, "series"]).join(found, [*KEYS, "series"], "left")


# Tables of the last stage and beside it


@query(f"""WITH {BINS_SQL}, s AS (SELECT uid, year, doy, avg(avg) OVER w AS avg, avg(p90) OVER w AS p90 FROM bins WINDOW w AS (PARTITION BY uid, year ORDER BY doy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
v AS (SELECT *, CASE uid % 3 WHEN 0 THEN avg ELSE p90 END AS v FROM s)
SELECT {_PLACE_SQL}, doy::BIGINT AS doy, round((v - min(v) OVER t) / (max(v) OVER t - min(v) OVER t), 6) AS scaled FROM v WINDOW t AS (PARTITION BY uid, year)""")
def profile_columns(spark, sf):
    """Smoothed files of three ages, whose column has three names, one of them beside another: profiles take the oldest name."""
    bins = _units(resample.binned_product(S.tree_years(spark, sf), S.TREE, strategies=("avg", "p90")))
    rows = smooth.rolling_mean(smooth.rolling_mean(bins, KEYS, "avg", 3, "doy", "old"), KEYS, "p90", 3, "doy", "new")
    root, kind = scratch(spark), F.col("uid").cast("int") % 3
    for i, (header, columns) in enumerate(((["date", "GCC-3D-p90_model", "p90"], ["old", "new"]), (["date", "GCC-3D-p90"], ["new"]), (["date", "avg", "p90"], ["old", "new"]))):
        body = files.csv_body(header, "date", [F.col("date"), *map(F.col, columns)])
        files.write_files(rows.where(kind == i).groupBy(*KEYS).agg(body.alias("body")).withColumn("path", files.tree_path("-GCC-3D-smoothed.csv")), root)
    smoothed = files.read_profiles(spark, root)
    return analytics.profiles(smoothed, smoothed, KEYS, ["value"])


@query(f"""WITH {_PAIRS} SELECT CASE threshold WHEN 'gu' THEN 'GCC_3D_p90-GU_50' ELSE 'GCC_3D_p90-GD_25' END AS threshold, upper(phase) || '_mid' AS phase, {_AGREE} FROM p GROUP BY ALL HAVING count(*) >= 10""")
def record_validation(spark, sf):
    """The table of records and that of visual dates, written, read by their names and compared."""
    name = lambda uid, year: F.concat_ws("_", uid.cast("string"), year.cast("string"))
    ours = S.records(spark, sf).select(name(F.col("uid"), F.col("year")).alias("full_name"), "species", "year", F.col("gu").alias("GCC_3D_p90-GU_50"), F.col("gd").alias("GCC_3D_p90-GD_25"))
    seen = S.table(spark, sf, "orders").groupBy(name(F.col("o_custkey"), F.year("o_orderdate")).alias("full_name")).agg(F.lit("x").alias("site"), F.avg(F.dayofyear("o_orderdate")).alias("LUD_mid"), (F.max("o_totalprice") / 2000).alias("LUH_mid"))
    root = scratch(spark)
    files.write_table(ours, f"{root}/records.csv", ["full_name"])
    files.write_table(seen, f"{root}/visual.csv", ["full_name"])
    records_, visual = files.read_records(spark, f"{root}/records.csv"), files.read_visual(spark, f"{root}/visual.csv")
    return analytics.visual_validation(records_, visual, "full_name", ["GCC_3D_p90-GU_50", "GCC_3D_p90-GD_25"], ["LUD_mid", "LUH_mid"])


def _report_sql() -> str:
    share = lambda n: f"format('{{:.1f}}', {n} / total * 100)"
    wide = lambda label, n: f"'{label}: ' || format('{{:>3d}}', {n}) || ' (' || {share(n)} || ' %)'"
    accepted = "(total - excluded - listed - spring_removed - autumn_removed)"
    lines = ["'Filtering Report'", "repeat('=', 16)", "'Total tree-years found : ' || total", f"'Fully accepted         : ' || {accepted} || ' (' || {share(accepted)} || ' %)'", wide("Partially accepted     ", "(spring_removed + autumn_removed)")]
    lines += [wide("  - Spring removed (GU NaN) ", "spring_removed"), wide("  - Autumn removed (GD NaN) ", "autumn_removed"), wide("Excluded (thresholds)  ", "excluded"), wide("Excluded (external CSV)", "listed")]
    lines += ["''", "'Per-season filters     : partial (failing season blanked)'", "''", "'Per-filter exclusions (independent counts — a tree-year may appear in multiple):'", "repeat('-', 78)", f"'  {'Filter':<55}  {'Excluded':>8}  {'%':>6}'", "repeat('-', 78)"]
    lines += [f"'  {label:<55}  ' || format('{{:>8d}}', rule_{i}) || '  ' || lpad({share(f'rule_{i}')}, 6, ' ') || ' %'" for i, label in enumerate(records.rule_labels(_RULES))]
    return f"WITH f AS ({ORACLES['filter_report']}), l AS (SELECT [{', '.join([*lines, repr('-' * 78)])}] AS l FROM f) SELECT unnest(generate_series(1, len(l)))::BIGINT AS place, unnest(l) AS line FROM l"


@query(_report_sql())
def report_lines(spark, sf):
    """The filtering report as it is written beside the records."""
    found = _records(spark, sf)
    text = records.report(records.counts(records.judged(found, _RULES, found.where("uid = 2").select("uid", "year")), _RULES).first().asDict(), _RULES)
    path = f"{scratch(spark)}.txt"
    files.write_text(spark, path, text)
    body = spark.read.text(path, wholetext=True)
    lines = body.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), r"\n", -1)).alias("place", "line"))
    return lines.select((F.col("place") + 1).cast("long").alias("place"), "line")
