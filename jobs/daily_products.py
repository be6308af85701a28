"""Daily products of observations as they arrive: takes files that are new, and makes the days anew that they touch.

    python -m jobs.daily_products --source FOLDER --out FOLDER --checkpoint FOLDER [--config jobs/daily_products.json]

``out/observations`` gathers what was taken, by day and batch; ``out/products`` has one row a series and day, by day.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyspark.operators import analytics, filters, resample

log = logging.getLogger("jobs.daily_products")


@dataclass
class Settings:
    """Names of the columns, bounds of the values that count, kinds that don't, and the products to make."""

    id: str = "event_id"
    keys: list[str] = field(default_factory=lambda: ["user_id"])
    time: str = "ts"
    value: str = "value"
    kind: str | None = "event_type"
    low: float = 0.0
    high: float = 1e9
    exclude: list[str] = field(default_factory=list)
    strategies: list[str] = field(default_factory=lambda: ["avg", "p50", "p75", "p90"])
    files_per_batch: int = 1000


def settings(path: str | Path = Path(__file__).with_suffix(".json")) -> Settings:
    return Settings(**json.loads(Path(path).read_text()))


def _replace_days(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` over its own partitions of the table at ``path`` and leave the others; a day's rows lie together, large days are split."""
    df.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def take(batch: DataFrame, number: int, out: str, cfg: Settings) -> None:
    """One batch: its observations go to their days, then every day that it touches is made from all observations of the day.

    A batch that is run again, after a failure anywhere in it, writes the same files over its own.
    """
    spark = batch.sparkSession
    rows = filters.brightness_filter(batch, cfg.value, cfg.low, cfg.high)
    if cfg.kind:
        rows = filters.exclude_locations(rows, cfg.exclude, cfg.kind)
    rows = rows.select(F.col(cfg.id).alias("id"), *cfg.keys, F.col(cfg.time).alias("ts"), F.col(cfg.value).cast("double").alias("value"), F.to_date(cfg.time).alias("date"), F.lit(number).cast("int").alias("batch"))
    rows = rows.where(F.col("ts").isNotNull())
    kept = f"{out}/observations"
    _replace_days(rows, kept, ["date", "batch"])
    found = spark.read.schema(rows.schema).parquet(kept)
    days = found.where(F.col("batch") == number).select("date").distinct()
    touched = found.join(F.broadcast(days), "date", "left_semi")  # days of one batch: few, and the scan is pruned by them
    # An observation that came again counts as it came last.
    latest = analytics.latest(touched.withColumn("_at", F.struct("batch", "ts", "value")), ["date", *cfg.keys, "id"], "_at").drop("_at")
    products = resample.daily_product(latest, cfg.keys, strategies=tuple(cfg.strategies), fill=False, counts="n")
    _replace_days(products.select(*cfg.keys, "doy", "n", *cfg.strategies, "date"), f"{out}/products", ["date"])
    log.info("batch %d: wrote %d observations and the products of %d days", number, found.where(F.col("batch") == number).count(), days.count())


def read(spark: SparkSession, source: str, out: str, cfg: Settings | None = None) -> DataFrame:
    """The products as they stand, with the keys' types as in ``source``; no rows where there are none yet."""
    cfg = cfg or settings()
    schema = spark.read.parquet(source).select(*cfg.keys, F.lit(0).alias("doy"), F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(s) for s in cfg.strategies], F.current_date().alias("date")).schema
    return spark.read.schema(schema).parquet(f"{out}/products")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, cfg: Settings | None = None) -> dict[str, int]:
    """Take the Parquet files below ``source`` (a folder or a pattern) that ``checkpoint`` doesn't know yet; returns counts.

    Observations without a time or a value, outside the bounds or of an excluded kind don't count. Products are exact
    after each run: late observations of a day make it anew. Where nothing is new, nothing is written.
    """
    cfg = cfg or settings()
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", cfg.files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, out, cfg)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    taken = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    done = {"read": sum(taken), "batches": len(taken)}
    log.info("%s: read %d new rows in %d batches for %s", source, done["read"], done["batches"], out)
    return done


def main(arguments: list[str] | None = None) -> None:
    from canopyspark.session import session

    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("source", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO)
    spark = session("daily products")
    try:
        run(spark, given.source, given.out, given.checkpoint, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
