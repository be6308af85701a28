"""Queries by name over the general tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import analytics, filters, montecarlo, records, resample, sampling, smooth, transitions
from . import standins as S
from .standins import BINS_SQL, CHANNELS_SQL, METRICS_SQL, RECORDS_SQL, TREE, TREE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: S.rounded(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Filters and joins


@query(f"WITH {CHANNELS_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(r + g + b, 6) AS brightness FROM channels WHERE r + g + b BETWEEN 50 AND 650")
def brightness_filter(spark, sf):
    rows = S.channels(spark, sf).withColumn("brightness", F.col("r") + F.col("g") + F.col("b"))
    return filters.brightness_filter(rows).select("l_orderkey", "l_linenumber", "brightness")


def _snow(spark, sf) -> DataFrame:
    orders = S.table(spark, sf, "orders").join(S.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.col("c_nationkey").alias("location"), F.to_date("o_orderdate").alias("date")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("snow"))


@query(f"""WITH {CHANNELS_SQL}, snow AS (
  SELECT c_nationkey AS location, o_orderdate::DATE AS date, bool_or(o_orderstatus = 'F') AS snow FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN coalesce(snow, false) THEN NULL ELSE round(g, 6) END AS g
FROM channels LEFT JOIN snow ON uid = location AND ts::DATE = date""")
def snow_mask(spark, sf):
    rows = S.channels(spark, sf).withColumnRenamed("uid", "location")
    return filters.mask_snow(rows, _snow(spark, sf), ["g"]).select("l_orderkey", "l_linenumber", "g")


@query(f"WITH {TREE_SQL} SELECT uid::BIGINT AS uid, year::BIGINT AS year, count(*) AS n FROM tree WHERE doy BETWEEN 60 AND 320 AND uid NOT IN (3, 7) GROUP BY ALL")
def season_and_exclusion(spark, sf):
    rows = filters.exclude_locations(filters.season(S.tree_years(spark, sf)), ["3", "7"], "uid")
    return rows.groupBy(*TREE).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_type AS category, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY ALL")
def category_filter(spark, sf):
    return filters.keep_categories(S.table(spark, sf, "part").withColumnRenamed("p_type", "category"), ["ECONOMY", "PROMO"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_PARTS = "SELECT p_brand, p_partkey AS path, p_size % 3 + 1 AS height, p_partkey % 5 + 1 AS width, row_number() OVER w - 1 AS i, greatest(1, count(*) OVER (PARTITION BY p_brand) // 25) AS step FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)"
_MODAL = f"""c AS (SELECT p_brand, height, width, count(*) AS n FROM ({_PARTS}) WHERE i % step = 0 GROUP BY ALL),
modal AS (SELECT p_brand, arg_max(height, (n, height * width, height, width)) AS height, arg_max(width, (n, height * width, height, width)) AS width FROM c GROUP BY ALL)"""


def _pictures_of_parts(spark, sf) -> DataFrame:
    return S.table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("path"), (F.col("p_size") % 3 + 1).alias("height"), (F.col("p_partkey") % 5 + 1).alias("width"))


@query(f"WITH {_MODAL} SELECT p_brand, height::BIGINT AS height, width::BIGINT AS width FROM modal")
def modal_shape(spark, sf):
    return filters.modal_shape(_pictures_of_parts(spark, sf), ["p_brand"])


@query(f"WITH {_MODAL} SELECT p_brand, path, height::BIGINT AS height, width::BIGINT AS width FROM ({_PARTS}) JOIN modal USING (p_brand, height, width)")
def of_modal_shape(spark, sf):
    pictures = _pictures_of_parts(spark, sf)
    return filters.of_shape(pictures, filters.modal_shape(pictures, ["p_brand"]), ["p_brand"]).select("p_brand", "path", "height", "width")


@query("SELECT DISTINCT c_nationkey::BIGINT AS nation FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def site_years_in_both(spark, sf):
    ours = S.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    return filters.in_units(ours, S.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"]).distinct()


@query("""WITH x AS (SELECT DISTINCT o_custkey AS uid, year(o_orderdate) AS year FROM orders WHERE o_orderpriority = '1-URGENT'),
r AS (SELECT DISTINCT o_custkey AS uid, year(o_orderdate) AS year FROM orders)
SELECT r.year::BIGINT AS year, count(*) AS n FROM r ANTI JOIN x USING (uid, year) GROUP BY ALL""")
def exclusion_anti_join(spark, sf):
    orders = S.table(spark, sf, "orders").withColumn("uid", F.col("o_custkey")).withColumn("year", F.year("o_orderdate"))
    listed = orders.where("o_orderpriority = '1-URGENT'").select("uid", "year").distinct()
    judged = records.judged(orders.select("uid", "year").distinct(), records.Rules(), listed)
    return judged.where("accepted").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, coalesce(r_name, 'none') AS region, count(c_custkey) AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def uid_lookup(spark, sf):
    """Nations take a region's name as regions take their uid; one region isn't in the list."""
    from .stages import with_uids

    names = S.table(spark, sf, "region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("annotation_id"), F.col("r_name").alias("uid"))
    nations = with_uids(S.table(spark, sf, "nation").withColumnRenamed("n_regionkey", "annotation_id"), names)
    joined = nations.join(S.table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name", F.coalesce("uid", F.lit("none")).alias("region")).agg(F.count("c_custkey").alias("n"))


@query("SELECT user_id AS uid, event_type, max(ts) AS ts FROM events GROUP BY ALL")
def last_write_wins(spark, sf):
    return analytics.latest(S.table(spark, sf, "events").select(F.col("user_id").alias("uid"), "event_type", "ts"), ["uid", "event_type"], "ts")


# Products


@query(f"WITH {CHANNELS_SQL}, m AS (SELECT uid, year, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(r + g + b) AS t FROM channels GROUP BY ALL) SELECT uid::BIGINT AS uid, year::BIGINT AS year, round(g / t, 6) AS gcc, round(r / t, 6) AS rcc, round(b / t, 6) AS bcc, round(t, 6) AS brightness FROM m")
def chroma_ratio(spark, sf):
    return S.channels(spark, sf).groupBy(*TREE).agg(*X.colour_ratios(F.col("r"), F.col("g"), F.col("b")))


@query("""WITH d AS (SELECT user_id AS uid, ts::DATE AS date, avg(value) AS avg, quantile_cont(value, [0.5, 0.75, 0.9]) AS q FROM events WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT uid, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY uid)
SELECT c.uid, c.date, dayofyear(c.date) AS doy, round(avg, 6) AS avg, round(q[1], 6) AS p50, round(q[2], 6) AS p75, round(q[3], 6) AS p90 FROM c LEFT JOIN d USING (uid, date)""")
def daily_product(spark, sf):
    return resample.daily_product(S.observations(spark, sf), ["uid"])


@query(f"""WITH {TREE_SQL}
SELECT uid::BIGINT AS uid, year::BIGINT AS year, make_date(year::INT, 1, 1) + (d - 1)::INT AS date, d AS doy, round(avg(value), 6) AS avg, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90
FROM (SELECT *, (2 + floor((doy - 2) / 3) * 3)::BIGINT AS d FROM tree WHERE doy >= 2) GROUP BY ALL""")
def three_day_product(spark, sf):
    return resample.binned_product(S.tree_years(spark, sf), TREE)


# Sampling


@query("""WITH e AS (SELECT event_id, user_id AS uid, ts, rank() OVER (PARTITION BY user_id, ts::DATE ORDER BY abs(epoch(ts::TIMESTAMP(0) - ts::DATE) - 43200), ts) AS k
FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)) SELECT event_id, uid, ts FROM e WHERE k = 1""")
def closest_to_noon(spark, sf):
    rows = S.table(spark, sf, "events").select("event_id", F.col("user_id").alias("uid"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return sampling.closest_to_noon(rows, ["uid"])


_SEASON = """(SELECT {k}, count(*) AS n, count(DISTINCT doy) AS days, min(doy) AS lo, max(doy) AS hi, epoch(max(ts) - min(ts)) AS sec, count(*) FILTER (step > 1) AS gaps, max(step) AS longest, max(hole) AS hole
  FROM (SELECT *, abs(doy - lag(doy) OVER (PARTITION BY {k} ORDER BY ts)) AS step, CASE WHEN doy <> lag(doy) OVER (PARTITION BY {k} ORDER BY doy) THEN doy - lag(doy) OVER (PARTITION BY {k} ORDER BY doy) - 1 END AS hole
        FROM tree WHERE doy BETWEEN {a} AND {b}) GROUP BY ALL)"""


def _season_columns(name: str, a: int, b: int) -> str:
    n = b - a + 1
    few = f"coalesce({name}.n, 0) < 2"
    return f"""round(CASE WHEN {few} THEN 0 ELSE {name}.days / {n}::DOUBLE END, 6) AS {name}_coverage_ratio,
  round(CASE WHEN {few} THEN 0 ELSE {name}.n / (floor({name}.sec / 86400) + 1) END, 6) AS {name}_avg_obs_per_day,
  CASE WHEN {few} THEN 1 ELSE {name}.gaps END AS {name}_n_gaps, CASE WHEN {few} THEN {n} ELSE {name}.longest END AS {name}_max_gap_days,
  CASE WHEN {few} THEN {n} ELSE greatest({name}.lo - {a}, {b} - {name}.hi, coalesce({name}.hole, 0)) END AS {name}_max_consecutive_missing_days"""


_FLAGS = f"""WITH {TREE_SQL}, l AS (
  SELECT *, abs(doy - lag(doy) OVER w) AS step, lag(ts) OVER w AS before, count(*) OVER (PARTITION BY uid, year, doy) AS same FROM tree WINDOW w AS (PARTITION BY uid, year ORDER BY ts)
), g AS (
  SELECT uid, year, strftime(min(ts), '%Y-%m-%d') AS start_date, strftime(max(ts), '%Y-%m-%d') AS end_date, round(count(*) / (floor(epoch(max(ts) - min(ts)) / 86400) + 1), 6) AS avg_obs_per_day,
         max(same) AS max_obs_per_day, min(same) AS min_obs_per_day, count(*) FILTER (step > 1) AS n_gaps,
         coalesce(string_agg(strftime(before + INTERVAL 1 DAY, '%Y-%m-%d'), ',' ORDER BY before) FILTER (step > 1), '') AS gap_start_dates, coalesce(string_agg(step::VARCHAR, ',' ORDER BY before) FILTER (step > 1), '') AS gap_lengths_day
  FROM l GROUP BY ALL
) SELECT g.uid::BIGINT AS uid, g.year::BIGINT AS year, g.* EXCLUDE (uid, year), {", ".join(_season_columns(s, a, b) for s, (a, b) in sampling.SEASONS.items())}
FROM g {" ".join(f"LEFT JOIN {_SEASON.format(k='uid, year', a=a, b=b)} {s} ON {s}.uid = g.uid AND {s}.year = g.year" for s, (a, b) in sampling.SEASONS.items())}"""


@query(_FLAGS)
def sampling_flags(spark, sf):
    flags = sampling.sampling_flags(S.tree_years(spark, sf), TREE)
    return flags.withColumn("gap_start_dates", F.array_join("gap_start_dates", ",")).withColumn("gap_lengths_day", F.array_join(F.col("gap_lengths_day").cast("array<string>"), ","))


@query(f"WITH {TREE_SQL}, c AS (SELECT uid, year, count(*) AS n FROM tree GROUP BY ALL) SELECT uid::BIGINT AS uid, arg_max(year, (n, -year))::BIGINT AS modal_year FROM c GROUP BY ALL")
def modal_year(spark, sf):
    return sampling.modal_year(S.tree_years(spark, sf), ["uid"])


_COUNTS = f"""{TREE_SQL}, c AS (SELECT uid, year, ts::DATE AS date, count(*) AS n FROM tree GROUP BY ALL),
cal AS (SELECT uid, year, unnest(generate_series(make_date(year::INT, 1, 1), make_date(year::INT, 12, 31), INTERVAL 1 DAY))::DATE AS date FROM (SELECT DISTINCT uid, year FROM tree)),
x AS (SELECT cal.uid, cal.year, dayofyear(cal.date) AS doy, coalesce(n, 0) AS n FROM cal LEFT JOIN c USING (uid, year, date)),
s AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cum, count(*) OVER p AS m, sum(n) OVER p AS total FROM x WHERE doy BETWEEN 60 AND 320 WINDOW w AS (PARTITION BY uid, year ORDER BY doy), p AS (PARTITION BY uid, year)),
t AS (SELECT uid, year, i, abs((total - cum) / (m - i) - cum / i) * sqrt(i * (m - i) / m::DOUBLE) AS stat FROM s WHERE i < m),
k AS (SELECT uid, year, arg_max(i, (stat, -i)) AS k, max(stat) AS stat FROM t GROUP BY ALL)"""


@query(f"WITH {_COUNTS} SELECT uid::BIGINT AS uid, year::BIGINT AS year, k, round(stat, 6) AS stat FROM k")
def change_point(spark, sf):
    counts = sampling.daily_counts(S.tree_years(spark, sf), TREE)
    return sampling.change_point(counts.where(F.col("doy").between(60, 320)), TREE)


@query(f"""WITH {_COUNTS}, a AS (
  SELECT x.uid, x.year, k + 59 AS kk, stat, min(n) FILTER (n > 0) AS least, max(n) AS most, avg(n) AS mean, count(*) FILTER (n > 0 AND doy <= k + 59) AS nb, count(*) FILTER (n > 0 AND doy > k + 59) AS na,
    quantile_cont(n, 0.5) FILTER (n > 0 AND doy <= k + 59) AS med_before, quantile_cont(n, 0.5) FILTER (n > 0 AND doy > k + 59) AS med_after,
    avg((n = 1)::INT) FILTER (n > 0 AND doy <= k + 59) AS f1, avg((n >= 2)::INT) FILTER (n > 0 AND doy > k + 59) AS f2, max(n) FILTER (doy = k + 55) AS w0, max(n) FILTER (doy = k + 64) AS w1
  FROM x JOIN k ON x.uid = k.uid AND x.year = k.year GROUP BY ALL
), b AS (SELECT *, CASE WHEN least <> 1 OR most < 3 OR mean < 0.3 THEN 'pre_filter' WHEN nb < 10 OR na < 10 THEN 'too_few_obs' END AS reason, w1 >= 2 AND w0 <= 1 AS sharp0 FROM a)
SELECT uid::BIGINT AS uid, year::BIGINT AS year, reason IS NULL AND med_before = 1 AND med_after >= 3 AND f1 >= 0.8 AND f2 >= 0.8 AND sharp0 AS detected, CASE WHEN reason IS NULL THEN kk + 1 END AS best_doy,
  CASE WHEN reason IS NULL THEN round(stat, 6) END AS stat, CASE WHEN reason IS NULL THEN med_before END AS med_before, CASE WHEN reason IS NULL THEN med_after END AS med_after,
  CASE WHEN reason IS NULL THEN round(f1, 6) END AS frac_before_1, CASE WHEN reason IS NULL THEN round(f2, 6) END AS frac_after_ge2, CASE WHEN reason IS NULL THEN sharp0 END AS sharp, reason FROM b""")
def step_detector(spark, sf):
    return sampling.step_detector(S.tree_years(spark, sf), TREE)


# Smoothing and transitions


def _bins(spark, sf) -> DataFrame:
    return resample.binned_product(S.tree_years(spark, sf), TREE, strategies=("avg", "p90"))


_SMOOTH = f"{BINS_SQL}, smooth AS (SELECT *, avg(p90) OVER (PARTITION BY uid, year ORDER BY doy ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smoothed FROM bins)"


@query(f"WITH {_SMOOTH} SELECT uid::BIGINT AS uid, year::BIGINT AS year, doy::BIGINT AS doy, round(p90, 6) AS p90, round(smoothed, 6) AS smoothed FROM smooth")
def rolling_mean(spark, sf):
    return smooth.rolling_mean(_bins(spark, sf), TREE, "p90", 7, "doy").select(*TREE, "doy", "p90", "smoothed")


def _cv_steps(candidates: tuple[int, ...] = (3, 5, 7, 9), folds: int = 5, longest: int = 122) -> str:
    """Steps from the bins to ``m``, the error of each candidate, and ``best``, the chosen one."""
    table = ", ".join(f"({n}, [{', '.join(map(str, smooth.fold_ids(n, folds).tolist()))}])" for n in range(folds, longest + 1))
    predictions = ", ".join(f"avg(CASE WHEN fold <> {f} THEN p90 END) OVER (PARTITION BY uid, year ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) AS p{w}_{f}" for w in candidates for f in range(folds))
    picked = ", ".join("CASE fold " + " ".join(f"WHEN {f} THEN p{w}_{f}" for f in range(folds)) + f" END AS q{w}" for w in candidates)
    chosen = " ".join(f"WHEN m{w} = least({', '.join(f'm{v}' for v in candidates)}) THEN {w}" for w in candidates)
    return f"""{BINS_SQL}, folds(n, f) AS (VALUES {table}), r AS (SELECT uid, year, p90, row_number() OVER (PARTITION BY uid, year ORDER BY doy) AS pos, count(*) OVER (PARTITION BY uid, year) AS n FROM bins),
z AS (SELECT r.*, f[pos] AS fold FROM r JOIN folds ON folds.n = r.n), y AS (SELECT *, {predictions} FROM z), x AS (SELECT uid, year, n, fold, p90, {picked} FROM y),
e AS (SELECT uid, year, n, fold, {", ".join(f"avg((p90 - q{w}) ** 2) AS e{w}" for w in candidates)} FROM x GROUP BY ALL), m AS (SELECT uid, year, n, {", ".join(f"avg(e{w}) AS m{w}" for w in candidates)} FROM e GROUP BY ALL),
best AS (SELECT uid, year, n, CASE {chosen} END AS best, least({", ".join(f"m{w}" for w in candidates)}) AS mse FROM m)"""


@query(f"WITH {_cv_steps()} SELECT uid::BIGINT AS uid, year::BIGINT AS year, n, best::BIGINT AS best, round(mse, 6) AS mse FROM best")
def cv_window(spark, sf):
    return smooth.cv_window(_bins(spark, sf), TREE, "p90", [3, 5, 7, 9], order="doy", longest=smooth.LONGEST)


@query(f"""WITH {TREE_SQL}, d AS (SELECT uid, year, doy, avg(value) AS avg FROM tree GROUP BY ALL), c AS (SELECT uid, year, unnest(range(min(doy), max(doy) + 1)) AS doy FROM d GROUP BY uid, year),
f AS (SELECT c.uid, c.year, c.doy, avg, CASE WHEN avg IS NOT NULL THEN c.doy END AS known FROM c LEFT JOIN d USING (uid, year, doy)),
n AS (SELECT *, last_value(known IGNORE NULLS) OVER w AS l, last_value(avg IGNORE NULLS) OVER w AS lv, first_value(known IGNORE NULLS) OVER v AS r, first_value(avg IGNORE NULLS) OVER v AS rv FROM f
  WINDOW w AS (PARTITION BY uid, year ORDER BY doy), v AS (PARTITION BY uid, year ORDER BY doy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT uid::BIGINT AS uid, year::BIGINT AS year, doy, round(coalesce(avg, lv + (rv - lv) * (doy - l) / (r - l), lv, rv), 6) AS filled FROM n""")
def interpolate(spark, sf):
    daily = resample.daily_product(S.tree_years(spark, sf), TREE, strategies=("avg",))
    return transitions.interpolate(daily, TREE, "avg", "doy").select(*TREE, "doy", "filled")


_SEASONED = f"""{_SMOOTH}, q AS (SELECT uid, year, doy, smoothed AS v, row_number() OVER w AS i, lead(smoothed) OVER w AS v1, lead(doy) OVER w AS d1 FROM smooth WHERE doy BETWEEN 60 AND 320 WINDOW w AS (PARTITION BY uid, year ORDER BY doy)),
a AS (SELECT uid, year, arg_max(i, (v, -i)) AS pi, arg_max(doy, (v, -i)) AS peak, max(v) AS peak_value, min(v) AS baseline FROM q GROUP BY ALL)"""


@query(f"""WITH {_SEASONED}, t AS (SELECT q.*, a.* EXCLUDE (uid, year), pct, baseline + (pct / 100::DOUBLE) * (peak_value - baseline) AS level FROM q JOIN a USING (uid, year) CROSS JOIN (VALUES (10), (25), (50), (75), (90)) p(pct)),
u AS (SELECT *, sign(v1 - level) - sign(v - level) AS turn, doy + (d1 - doy) * (level - v) / (v1 - v) AS day FROM t)
SELECT uid::BIGINT AS uid, year::BIGINT AS year, peak::BIGINT AS peak, round(peak_value, 6) AS peak_value, round(baseline, 6) AS baseline, round(peak_value - baseline, 6) AS amplitude, pct::BIGINT AS pct,
  round(arg_max(day, i) FILTER (i < pi AND turn > 0), 6) AS up, round(arg_min(day, i) FILTER (i >= pi AND turn < 0), 6) AS down FROM u GROUP BY uid, year, peak, peak_value, baseline, pct""")
def threshold_crossings(spark, sf):
    smoothed = smooth.rolling_mean(_bins(spark, sf), TREE, "p90", 7, "doy")
    return transitions.crossings(smoothed, TREE, order="doy").select(*TREE, "peak", "peak_value", "baseline", "amplitude", "pct", "up", "down")


@query(f"""WITH {_SEASONED}, d AS (SELECT uid, year, doy, smoothed AS v, sign(smoothed - lag(smoothed) OVER w) AS s FROM smooth WINDOW w AS (PARTITION BY uid, year ORDER BY doy)),
c AS (SELECT *, s - lag(s) OVER (PARTITION BY uid, year ORDER BY doy) AS c FROM d), m AS (SELECT *, row_number() OVER (PARTITION BY uid, year ORDER BY doy) AS j FROM c WHERE c IS NULL OR c <> 0),
x AS (SELECT uid, year, v, lead(v) OVER (PARTITION BY uid, year ORDER BY doy) AS nv FROM m WHERE j > 1)
SELECT a.uid::BIGINT AS uid, a.year::BIGINT AS year, count(*) FILTER (nv > v AND nv - v > 0.5 * (peak_value - baseline)) AS n_peak FROM a LEFT JOIN x ON a.uid = x.uid AND a.year = x.year GROUP BY a.uid, a.year""")
def extrema_cycles(spark, sf):
    smoothed = smooth.rolling_mean(_bins(spark, sf), TREE, "p90", 7, "doy")
    amplitudes = transitions.crossings(smoothed, TREE, order="doy", thresholds=(0.5,)).select(*TREE, "amplitude")
    return transitions.cycles(smoothed, TREE, "smoothed", amplitudes, "doy")


@query(f"WITH {_SMOOTH} SELECT uid::BIGINT AS uid, year::BIGINT AS year, round(sqrt(avg((p90 - smoothed) ** 2)), 6) AS noise_std, round(10 * log10(var_pop(smoothed) / var_pop(p90 - smoothed)), 6) AS snr FROM smooth GROUP BY uid, year")
def snr_noise(spark, sf):
    return transitions.signal_quality(smooth.rolling_mean(_bins(spark, sf), TREE, "p90", 7, "doy"), TREE, "p90", "smoothed")


@query()
def monte_carlo(spark, sf):
    smoothed = smooth.rolling_mean(_bins(spark, sf), TREE, "p90", 7, "doy")
    return montecarlo.uncertainties(smoothed, TREE, "p90", "smoothed", [3, 5, 7, 9], seed=7, order="doy")


_DATES = ", ".join(f"round(max(CASE WHEN pct = {p} THEN {c} END), 6) AS G{d}_{p}" for p in (10, 25, 50, 75, 90) for d, c in (("U", "up"), ("D", "down")))


@query(f"""WITH {_cv_steps()},
smooth AS (SELECT bins.uid, bins.year, doy, CASE best {" ".join(f"WHEN {w} THEN avg(p90) OVER (PARTITION BY bins.uid, bins.year ORDER BY doy ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)" for w in (3, 5, 7, 9))} END AS smoothed
  FROM bins JOIN best ON best.uid = bins.uid AND best.year = bins.year),
{_SEASONED.removeprefix(_SMOOTH).lstrip(", ")}, t AS (SELECT q.*, a.* EXCLUDE (uid, year), pct, baseline + (pct / 100::DOUBLE) * (peak_value - baseline) AS level FROM q JOIN a USING (uid, year) CROSS JOIN (VALUES (10), (25), (50), (75), (90)) p(pct)),
u AS (SELECT *, sign(v1 - level) - sign(v - level) AS turn, doy + (d1 - doy) * (level - v) / (v1 - v) AS day FROM t),
marks AS (SELECT uid, year, peak, peak_value, baseline, pct, arg_max(day, i) FILTER (i < pi AND turn > 0) AS up, arg_min(day, i) FILTER (i >= pi AND turn < 0) AS down FROM u GROUP BY ALL)
SELECT uid::BIGINT AS uid, year::BIGINT AS year, round(peak_value - baseline, 6) AS amplitude, round(baseline, 6) AS baseline, peak::DOUBLE AS PEAK, {_DATES} FROM marks GROUP BY uid, year, peak, peak_value, baseline""")
def transition_dates(spark, sf):
    """The whole third stage but its noise: products, selected windows, dates, quality."""
    best = smooth.cv_smooth(_bins(spark, sf), TREE, "p90", [3, 5, 7, 9], order="doy", longest=smooth.LONGEST)
    found = transitions.transitions(best, TREE, order="doy")
    names = ["PEAK", *(f"G{d}_{p}" for p in (10, 25, 50, 75, 90) for d in "UD")]
    return found.select(*TREE, "amplitude", "baseline", *[F.try_element_at("dates", F.lit(n)).alias(n) for n in names])


@query(f"WITH {BINS_SQL} SELECT uid::BIGINT AS uid, year::BIGINT AS year, doy::BIGINT AS doy, round((avg - min(avg) OVER w) / (max(avg) OVER w - min(avg) OVER w), 6) AS scaled FROM bins WINDOW w AS (PARTITION BY uid, year)")
def minmax_scale(spark, sf):
    return transitions.minmax(_bins(spark, sf), TREE, "avg").select(*TREE, "doy", "scaled")


# Records

_RULES = records.Rules(
    min_thresholds={"snr": 4.5, "GCC_3D_p90-season_length": 100}, max_thresholds={"spring_max_consecutive_missing_days": 6, "GCC_3D_p90-GU_50-std": 8, "GCC_3D_p90-GD_25-std": 9},
    nan_ok_keys=["GCC_3D_p90-season_length"], required_keys=["GCC_3D_p90-GD_25"])
_JUDGED = f"""{METRICS_SQL}, j AS (
  SELECT *, gd - gu AS len, coalesce(snr_g, 0) < 4.5 OR coalesce(snr_r, 9) < 4.5 AS bad_snr, coalesce(gd - gu < 100, false) AS bad_len, few OR missing > 6 AS bad_missing, gu_std > 8 AS bad_std,
  few OR (NOT isnan(gd_std) AND gd_std > 9) AS bad_gd, gd IS NULL AS lacks_gd FROM wide
), o AS (SELECT *, NOT bad_snr AND NOT bad_len AND NOT lacks_gd AS whole_ok, NOT bad_missing AND NOT bad_std AS spring_ok, NOT bad_gd AS autumn_ok FROM j)"""


def _records(spark, sf) -> DataFrame:
    return records.with_defaults(records.gather(S.record_metrics(spark, sf), TREE))


@query(f"WITH {METRICS_SQL} SELECT uid::BIGINT AS uid, year::BIGINT AS year, gu AS gu_50, gd AS gd_25, gd - gu AS season_length, round(snr_g, 6) AS snr, missing, 0.0::DOUBLE AS noon FROM wide")
def record_pivot(spark, sf):
    names = {"GCC_3D_p90-GU_50": "gu_50", "GCC_3D_p90-GD_25": "gd_25", "GCC_3D_p90-season_length": "season_length", "GCC_3D_p90-snr": "snr", "spring_max_consecutive_missing_days": "missing", "noon_only_applied": "noon"}
    return records.widen(_records(spark, sf), list(names), TREE).withColumnsRenamed(names)


@query(f"WITH {_JUDGED} SELECT uid::BIGINT AS uid, year::BIGINT AS year, whole_ok AND spring_ok AND autumn_ok AS hard, spring_ok, autumn_ok FROM o")
def threshold_filter(spark, sf):
    hard = records.Rules(_RULES.min_thresholds, _RULES.max_thresholds, _RULES.nan_ok_keys, _RULES.required_keys, allow_partial=False)
    return records.judged(_records(spark, sf), hard).select(*TREE, F.col("accepted").alias("hard"), "spring_ok", "autumn_ok")


@query(f"WITH {_JUDGED} SELECT uid::BIGINT AS uid, year::BIGINT AS year, CASE WHEN spring_ok THEN gu END AS gu_50, CASE WHEN autumn_ok THEN gd END AS gd_25 FROM o WHERE whole_ok AND (spring_ok OR autumn_ok)")
def partial_blanking(spark, sf):
    kept = records.filtered(records.judged(_records(spark, sf), _RULES))
    return records.widen(kept, ["GCC_3D_p90-GU_50", "GCC_3D_p90-GD_25"], TREE, nan_as_null=True).toDF(*TREE, "gu_50", "gd_25")


@query(f"""WITH {_JUDGED}, k AS (SELECT *, whole_ok AND (spring_ok OR autumn_ok) AS ok FROM o) SELECT count(*) AS total, count(*) FILTER (NOT ok AND uid <> 2) AS excluded, count(*) FILTER (uid = 2) AS listed,
count(*) FILTER (ok AND NOT spring_ok AND uid <> 2) AS spring_removed, count(*) FILTER (ok AND NOT autumn_ok AND uid <> 2) AS autumn_removed,
count(*) FILTER (bad_snr) AS rule_0, count(*) FILTER (bad_len) AS rule_1, count(*) FILTER (bad_missing) AS rule_2, count(*) FILTER (bad_std) AS rule_3, count(*) FILTER (bad_gd) AS rule_4, count(*) FILTER (lacks_gd) AS rule_5 FROM k""")
def filter_report(spark, sf):
    found = _records(spark, sf)
    return records.counts(records.judged(found, _RULES, found.where("uid = 2").select("uid", "year")), _RULES)


# Analyses


@query(f"WITH {RECORDS_SQL} SELECT species, count(*) AS n_series, count(DISTINCT uid) AS n_uid FROM records GROUP BY ALL HAVING count(*) >= 50")
def species_counts(spark, sf):
    return analytics.species_counts(S.records(spark, sf))


@query(f"WITH {RECORDS_SQL} SELECT f.species, coalesce(c.n, 0) AS curated, f.n AS full FROM (SELECT species, count(*) AS n FROM records GROUP BY ALL) f FULL JOIN (SELECT species, count(*) AS n FROM records WHERE gu < 50 AND species <> 'BUILDING' GROUP BY ALL) c ON f.species = c.species")
def curated_against_full(spark, sf):
    full = S.records(spark, sf)
    return analytics.curated_against_full(full.where("gu < 50 AND species <> 'BUILDING'"), full)


_SITES = list(range(8))


@query(f"""WITH {RECORDS_SQL}, few AS (SELECT * FROM records WHERE (site + year) % 5 <> 0 AND year - 1994 >= site % 3),
f AS (SELECT site, min(year) AS first FROM few GROUP BY ALL), y AS (SELECT DISTINCT year FROM few), h AS (SELECT DISTINCT site, year FROM few),
s AS (SELECT f.site, y.year, CASE WHEN h.site IS NOT NULL THEN 1 WHEN y.year < first THEN -1 ELSE 0 END AS s FROM f CROSS JOIN y LEFT JOIN h ON h.site = f.site AND h.year = y.year)
SELECT year::BIGINT AS year, {", ".join(f'coalesce(max(s) FILTER (site = {i}), -1)::BIGINT AS "{i}"' for i in _SITES)}, count(*) FILTER (s = 1) AS present FROM s GROUP BY year""")
def presence_matrix(spark, sf):
    some = S.records(spark, sf).where("(site + year) % 5 <> 0 AND year - 1994 >= site % 3")
    return analytics.presence(some, _SITES)


@query(f"WITH {RECORDS_SQL} SELECT year::BIGINT AS year, {', '.join(f'count(*) FILTER (site = {i}) AS {chr(34)}{i}{chr(34)}' for i in _SITES)}, count(*) AS total FROM records GROUP BY year")
def series_per_site_year(spark, sf):
    return analytics.series_per_site_year(S.records(spark, sf), _SITES)


@query("WITH p AS (SELECT user_id, event_type, count(DISTINCT ts) / count(DISTINCT ts::DATE) AS per_day FROM events GROUP BY ALL) SELECT event_type, round(max(per_day), 6) AS per_day FROM p GROUP BY ALL")
def observations_per_day(spark, sf):
    return analytics.observations_per_day(S.table(spark, sf, "events"), ["user_id", "event_type"], over=["event_type"])


@query(f"WITH {RECORDS_SQL} SELECT species, band, round(avg(gd - gu), 6) AS length_mean, round(stddev_samp(gd - gu), 6) AS length_std, count(*) AS length_n, count(DISTINCT uid) AS n_distinct FROM records GROUP BY ALL")
def season_length(spark, sf):
    return analytics.group_stats(S.records(spark, sf).withColumn("length", X.season_length(F.col("gu"), F.col("gd"))), ["species", "band"], ["length"], "uid")


@query(f"WITH {RECORDS_SQL} SELECT species, band, round(avg(gu), 6) AS gu_mean, round(stddev_samp(gu), 6) AS gu_std, count(gu) AS gu_n, round(avg(gd), 6) AS gd_mean, round(stddev_samp(gd), 6) AS gd_std, count(gd) AS gd_n FROM records GROUP BY ALL")
def phase_table(spark, sf):
    return analytics.group_stats(S.records(spark, sf), ["species", "band"], ["gu", "gd"])


@query(f"WITH {RECORDS_SQL} SELECT 'gu' AS phase, round(avg(gu) * 1.96::DOUBLE, 6) AS half_width FROM records UNION ALL SELECT 'gd', round(avg(gd) * 1.96::DOUBLE, 6) FROM records")
def ci_halfwidth(spark, sf):
    return analytics.half_widths(S.records(spark, sf), ["gu", "gd"])


def _balanced_sql(rows: str, key: str) -> str:
    return f"""{rows}, n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM r GROUP BY band, species)),
e AS (SELECT *, row_number() OVER (PARTITION BY band, species, {key}, gu, gd) AS copy FROM r),
d AS (SELECT e.*, draw, row_number() OVER (PARTITION BY draw, band, species ORDER BY md5(concat_ws('|', '3', draw, {key}, gu, gd, copy)), {key}, gu, gd, copy) AS k FROM e CROSS JOIN range(100) g(draw)),
m AS (SELECT draw, species, avg(gu) AS gu, avg(gd) AS gd FROM d, n WHERE k <= n GROUP BY ALL) SELECT species, round(avg(gu), 6) AS gu, round(avg(gd), 6) AS gd FROM m GROUP BY ALL"""


@query("WITH " + _balanced_sql(f"{RECORDS_SQL}, r AS (SELECT * FROM records)", "uid"))
def balanced_means(spark, sf):
    return analytics.balanced_means(S.records(spark, sf), ["band"], "species", ["gu", "gd"], seed=3)


@query("WITH " + _balanced_sql("r AS (SELECT o_orderpriority AS band, o_orderstatus AS species, o_custkey % 5 AS uid, dayofyear(o_orderdate)::DOUBLE AS gu, floor(o_totalprice / 50000)::DOUBLE AS gd FROM orders)", "uid"))
def balanced_means_of_repeated_keys(spark, sf):
    """As balanced_means, where five keys hold all rows and many rows are equal."""
    rows = S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("band"), F.col("o_orderstatus").alias("species"), (F.col("o_custkey") % 5).alias("uid"), F.dayofyear("o_orderdate").cast("double").alias("gu"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("gd"))
    return analytics.balanced_means(rows, ["band"], "species", ["gu", "gd"], seed=3)


@query(f"""WITH {BINS_SQL}, z AS (SELECT year, doy, (p90 - min(p90) OVER w) / (max(p90) OVER w - min(p90) OVER w) AS v FROM bins WINDOW w AS (PARTITION BY uid, year))
SELECT year::BIGINT AS year, doy::BIGINT AS doy, count(*) AS n, {", ".join(f"round(quantile_cont(v, {q / 100}), 6) AS q{q:02d}" for q in (5, 10, 25, 50, 75, 90, 95))} FROM z WHERE v IS NOT NULL GROUP BY ALL""")
def profile_bands(spark, sf):
    return analytics.profile_bands(transitions.minmax(_bins(spark, sf), TREE, "p90"), ["year"], "scaled")


@query(f"WITH {RECORDS_SQL}, u AS (SELECT species, 'gu' AS phase, gu AS day FROM records UNION ALL SELECT species, 'gd', gd FROM records) SELECT species, phase, round(quantile_cont(day, 0.5), 6) AS median, round(avg(day), 6) AS mean, round(stddev_samp(day), 6) AS std FROM u GROUP BY ALL")
def phase_markers(spark, sf):
    return analytics.phase_markers(S.records(spark, sf), ["gu", "gd"], ["species"])


_AGREE = "count(*) AS n, round(regr_r2(y, x), 6) AS r2, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(avg(y - x), 6) AS bias, round(sqrt(avg((y - x) ** 2)), 6) AS rmse"


@query(f"""WITH {RECORDS_SQL}, ref AS (SELECT year(l_shipdate) AS year, s_nationkey % 8 AS site, avg(dayofyear(l_shipdate)) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
m AS (SELECT site, year, avg(gu) AS gu, avg(gd) AS gd FROM records GROUP BY ALL HAVING count(*) > 5), p AS (SELECT 'gu' AS threshold, gu AS y, x FROM m JOIN ref USING (site, year) UNION ALL SELECT 'gd', gd, x FROM m JOIN ref USING (site, year))
SELECT threshold, {_AGREE} FROM p GROUP BY ALL""")
def network_validation(spark, sf):
    network = S.tree_years(spark, sf).groupBy("year", (F.col("uid") % 8).alias("site")).agg(F.avg("doy").alias("spn"))
    return analytics.network_validation(S.records(spark, sf), network, ["site", "year"], ["gu", "gd"], "spn")


_PAIRS = f"""{RECORDS_SQL}, o AS (SELECT uid * 10000 + year AS key, gu, gd FROM records), v AS (SELECT o_custkey * 10000 + year(o_orderdate) AS key, avg(dayofyear(o_orderdate)) AS lud, max(o_totalprice) / 2000 AS luh FROM orders GROUP BY ALL),
p AS (SELECT t AS threshold, f AS phase, CASE t WHEN 'gu' THEN gu ELSE gd END AS y, CASE f WHEN 'lud' THEN lud ELSE luh END AS x FROM o JOIN v USING (key) CROSS JOIN (VALUES ('gu'), ('gd')) a(t) CROSS JOIN (VALUES ('lud'), ('luh')) b(f))"""


def _visual(spark, sf, clip=None) -> DataFrame:
    ours = S.records(spark, sf).withColumn("key", F.col("uid") * 10000 + F.col("year"))
    seen = S.table(spark, sf, "orders").groupBy((F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("key")).agg(F.avg(F.dayofyear("o_orderdate")).alias("lud"), (F.max("o_totalprice") / 2000).alias("luh"))
    return analytics.visual_validation(ours, seen, "key", ["gu", "gd"], ["lud", "luh"], clip=clip)


@query(f"WITH {_PAIRS} SELECT threshold, phase, {_AGREE} FROM p GROUP BY ALL HAVING count(*) >= 10")
def visual_validation(spark, sf):
    return _visual(spark, sf)


_CLIP = """q AS (SELECT threshold, phase, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM (SELECT threshold, phase, x AS v FROM p UNION ALL SELECT threshold, phase, y FROM p) GROUP BY ALL),
k AS (SELECT p.* FROM p JOIN q USING (threshold, phase) WHERE x BETWEEN lo AND hi AND y BETWEEN lo AND hi)"""


@query(f"WITH {_PAIRS}, {_CLIP} SELECT threshold, phase, {_AGREE} FROM k GROUP BY ALL HAVING count(*) >= 10")
def clipped_validation(spark, sf):
    return _visual(spark, sf, (0.02, 0.98))


@query(f"WITH {_PAIRS}, e AS (SELECT threshold, phase, sqrt(avg((y - x) ** 2)) AS rmse FROM p GROUP BY ALL) SELECT threshold, round(max(rmse) FILTER (phase = 'lud'), 6) AS lud, round(max(rmse) FILTER (phase = 'luh'), 6) AS luh, arg_min(phase, (rmse, phase)) AS best FROM e GROUP BY ALL")
def rmse_pivot(spark, sf):
    return analytics.best_phase(_visual(spark, sf), ["lud", "luh"])


@query("SELECT p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type LIMIT 5")
def top_categories(spark, sf):
    return analytics.value_counts(S.table(spark, sf, "part"), "p_type", 5)


@query("WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey FROM r WHERE k = floor(n * 0.5) + 1")
def row_at_fraction(spark, sf):
    return analytics.row_at_fraction(S.table(spark, sf, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey")


# Scalars


@query("""SELECT p_partkey, 'Tree' || CASE WHEN length(p_partkey::VARCHAR) < 4 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END AS full_name, CASE WHEN p_size < 10 THEN 'analysis' ELSE 'panorama' END AS camera,
trim(split_part(p_name, ' ', 1)) AS label, upper(p_name)[1] || '. ' || split_part(upper(p_name), ' ', -1) AS compact, 'GCC_3D_p90' AS prefix, 'GU_' || p_size || '-std' AS deviation FROM part""")
def names(spark, sf):
    parts = S.table(spark, sf, "part")
    name = F.concat(F.lit("I."), F.col("p_partkey").cast("string"))
    location = F.when(F.col("p_size") < 10, "1150").otherwise("x115")
    stem = F.concat(X.full_name(name), F.lit("-GCC-3D-p90-transitions"))
    return parts.select("p_partkey", X.full_name(name).alias("full_name"), X.camera_type(location).alias("camera"), X.site_label(F.concat(F.lit("a: "), F.split("p_name", " ")[0], F.lit(" "))).alias("label"),
                        X.compact_name(F.upper("p_name")).alias("compact"), X.product_prefix(stem, X.full_name(name)).alias("prefix"), X.deviation_key(F.concat(F.lit("GU_"), F.col("p_size").cast("string"), F.lit("_std"))).alias("deviation"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('second', ts) END AS taken FROM events")
def parse_filename(spark, sf):
    new = F.concat(F.lit("a/b/cam_"), F.date_format("ts", "yyyy-MM-dd_HHmm"), F.lit(".jpg"))
    old = F.concat(F.lit("a/b/"), F.date_format("ts", "yyyy_MMdd_HHmmss"), F.lit(".png"))
    path = F.when(F.col("event_id") % 3 == 0, new).when(F.col("event_id") % 3 == 1, old).otherwise(F.lit("a/b/other.jpg"))
    return S.table(spark, sf, "events").select("event_id", X.picture_time(path).alias("taken"))


@query("""WITH r AS (SELECT vec_id, [[embedding[1], embedding[2]], [embedding[3], embedding[4]], [embedding[5], embedding[6]]]::DOUBLE[][] AS r FROM embeddings)
SELECT vec_id, round(abs(r[1][1] * r[2][2] - r[2][1] * r[1][2] + r[2][1] * r[3][2] - r[3][1] * r[2][2] + r[3][1] * r[1][2] - r[1][1] * r[3][2]) / 2, 6) AS area,
round(greatest(r[1][1], r[2][1], r[3][1]) - least(r[1][1], r[2][1], r[3][1]), 6) AS width FROM r""")
def polygon_area(spark, sf):
    e = F.col("embedding").cast("array<double>")
    ring = F.array(F.array(e[0], e[1]), F.array(e[2], e[3]), F.array(e[4], e[5]))
    return S.table(spark, sf, "embeddings").select("vec_id", X.shoelace(ring).alias("area"), X.extent(ring, 0).alias("width"))


@query(f"""WITH {TREE_SQL} SELECT uid::BIGINT AS uid, year::BIGINT AS year, 101 - count(DISTINCT doy) AS missing FROM tree WHERE doy BETWEEN 60 AND 160 GROUP BY ALL""")
def missing_days(spark, sf):
    days = sampling.missing_days(S.tree_years(spark, sf), TREE, 60, 160)
    return days.select(*TREE, F.size("missing").alias("missing"))


# Those of the remaining that read and write files, or work on pictures and polygons.
from . import file_queries  # noqa: E402, F401
