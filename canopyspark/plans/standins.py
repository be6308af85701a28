"""Tables of the engine's kind made from general ones: what stands for observations, series, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A series: supplier's nation and year of shipping.
TREE = ["uid", "year"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as longs: what can be compared between engines."""

    def of(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "double":
            return F.round(c, digits).alias(name)
        return c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else c

    return df.select(*[of(n, k) for n, k in df.dtypes])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations within days: ``uid, ts, value``."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("uid"), "ts", "value")


def tree_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uid, year, ts, doy, value``: one row a shipped line."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    nations = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("s_nationkey").alias("uid"), F.year("l_shipdate").alias("year"), F.col("l_shipdate").alias("ts"), F.dayofyear("l_shipdate").alias("doy"), (F.col("l_extendedprice") / 1000).alias("value"))


#: The same in DuckDB.
TREE_SQL = """tree AS (
  SELECT s_nationkey AS uid, year(l_shipdate) AS year, l_shipdate AS ts, dayofyear(l_shipdate) AS doy, l_extendedprice / 1000 AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""
BINS_SQL = f"""{TREE_SQL}, bins AS (
  SELECT uid, year, (2 + floor((doy - 2) / 3) * 3)::INT AS doy, quantile_cont(value, 0.9) AS p90, avg(value) AS avg
  FROM tree WHERE doy >= 2 GROUP BY ALL
)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, l_linenumber, uid, year, r, g, b``: three channels from a line's quantity, price and discount."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select("l_orderkey", "l_linenumber", F.col("s_nationkey").alias("uid"), F.year("l_shipdate").alias("year"), F.col("l_shipdate").alias("ts"), (F.col("l_quantity") * 4).alias("r"), (F.col("l_extendedprice") / 500).alias("g"), (F.col("l_discount") * 1000).alias("b"))


CHANNELS_SQL = """channels AS (
  SELECT l_orderkey, l_linenumber, s_nationkey AS uid, year(l_shipdate) AS year, l_shipdate AS ts, l_quantity * 4 AS r, l_extendedprice / 500 AS g, l_discount * 1000 AS b
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""


def record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metrics of (nation, year): ``uid, year, metric, value``. Some are absent, some null, some NaN."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.groupBy(F.col("c_nationkey").alias("uid"), F.year("o_orderdate").alias("year")).agg(
        F.min(F.dayofyear("o_orderdate")).cast("double").alias("lo"), F.max(F.dayofyear("o_orderdate")).cast("double").alias("hi"),
        F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("o_orderstatus") == "P").cast("double").alias("p"),
    )
    mark = (F.col("uid") + F.col("year")) % 7
    entries = F.array(
        F.struct(F.lit("GCC_3D_p90-GU_50").alias("metric"), (F.col("lo") + 100).alias("value")),
        F.struct(F.lit("GCC_3D_p90-GD_25").alias("metric"), F.when(mark != 3, F.col("hi") - 80).alias("value")),
        F.struct(F.lit("GCC_3D_p90-GU_50-std").alias("metric"), (F.col("n") % 11).alias("value")),
        F.struct(F.lit("GCC_3D_p90-snr").alias("metric"), (F.log10("mean") * 10 - 48).alias("value")),
        F.struct(F.lit("RCC_3D_p90-snr").alias("metric"), (F.log10("mean") * 10 - 47.5).alias("value")),
        F.struct(F.lit("spring_max_consecutive_missing_days").alias("metric"), (F.col("p") % 9).alias("value")),
        F.struct(F.lit("GCC_3D_p90-GD_25-std").alias("metric"), F.when(F.col("n") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("hi") % 13).alias("value")),
    )
    return rows.select("uid", "year", F.explode(F.when(mark == 5, F.slice(entries, 1, 4)).otherwise(entries)).alias("e")).select("uid", "year", "e.*")


METRICS_SQL = """base AS (
  SELECT c_nationkey AS uid, year(o_orderdate) AS year, min(dayofyear(o_orderdate))::DOUBLE AS lo, max(dayofyear(o_orderdate))::DOUBLE AS hi,
         avg(o_totalprice) AS mean, count(*)::DOUBLE AS n, (count(*) FILTER (o_orderstatus = 'P'))::DOUBLE AS p, (c_nationkey + year(o_orderdate)) % 7 AS mark
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), wide AS (
  SELECT uid, year, mark = 5 AS few, lo + 100 AS gu, CASE WHEN mark <> 3 THEN hi - 80 END AS gd, n % 11 AS gu_std, log10(mean) * 10 - 48 AS snr_g,
         CASE WHEN mark <> 5 THEN log10(mean) * 10 - 47.5 END AS snr_r, CASE WHEN mark <> 5 THEN p % 9 END AS missing,
         CASE WHEN mark <> 5 THEN CASE WHEN n % 5 = 0 THEN 'nan'::DOUBLE ELSE hi % 13 END END AS gd_std
  FROM base
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of records: ``uid, species, site, band, year, gu, gd`` of customers' first orders of a year."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.groupBy(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("species"), (F.col("c_nationkey") % 8).alias("site"), F.year("o_orderdate").alias("year")).agg(
        F.min(F.dayofyear("o_orderdate")).cast("double").alias("gu"), F.max(F.dayofyear("o_orderdate")).cast("double").alias("gd"), F.max("c_acctbal").alias("acctbal"))
    from ..functions.expressions import elevation_band

    return rows.withColumn("band", elevation_band(F.col("acctbal") / 5)).drop("acctbal")


RECORDS_SQL = """records AS (
  SELECT c_custkey AS uid, c_mktsegment AS species, c_nationkey % 8 AS site, year(o_orderdate) AS year,
         min(dayofyear(o_orderdate))::DOUBLE AS gu, max(dayofyear(o_orderdate))::DOUBLE AS gd,
         CASE WHEN max(c_acctbal) / 5 < 600 THEN 'Low' WHEN max(c_acctbal) / 5 < 1000 THEN 'Mid' WHEN max(c_acctbal) / 5 < 1500 THEN 'High' ELSE 'Very High' END AS band
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
)"""
