"""The jobs as queries: each runs twice into a new folder that all hosts share, and its output is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyspark.session import shared_folder

from . import daily_products, text_archive


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_daily_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events taken as files of observations; the second run finds nothing new."""
    folder = _folder(spark, "job1")
    for _ in range(2):  # a pattern, because the table can be a file as well as a folder
        daily_products.run(spark, f"{sf_dir}/[e]vents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    products = daily_products.read(spark, f"{sf_dir}/events.parquet", f"{folder}/out")
    return products.select("user_id", "date", F.col("doy").cast("long").alias("doy"), "n", *[F.round(c, 6).alias(c) for c in ("avg", "p50", "p75", "p90")])


def job2_text_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged; the second run writes the same rows again."""
    folder = _folder(spark, "job2")
    for _ in range(2):
        text_archive.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder)
    rows = text_archive.read(spark, folder)
    return rows.select("doc_id", "source", "lang", "status", F.array_join("failed", "; ").alias("failed"), *[F.round(c, 6).alias(c) for c in text_archive.METRICS], F.col("quality").cast("long").alias("quality"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_daily_products": job1_daily_products, "job2_text_archive": job2_text_archive}


def _job1_sql(cfg: daily_products.Settings) -> str:
    gone = ", ".join(f"'{x}'" for x in cfg.exclude)
    return f"""
SELECT user_id, ts::DATE AS date, dayofyear(ts)::BIGINT AS doy, count(*) AS n, round(avg(value), 6) AS avg,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90
FROM events WHERE value BETWEEN {cfg.low} AND {cfg.high} AND NOT isnan(value) AND (event_type IS NULL OR event_type NOT IN ({gone})) AND ts IS NOT NULL
GROUP BY user_id, ts::DATE, dayofyear(ts)
"""


def _job2_sql(cfg: text_archive.Settings) -> str:
    labels = text_archive.records.rule_labels(cfg.rules())
    tests = [f"coalesce({k} < {b}, true)" for k, b in cfg.min_thresholds.items()] + [f"coalesce({k} > {b}, true)" for k, b in cfg.max_thresholds.items()] + ["lang IS NULL" for _ in cfg.required_keys]
    listed = ", ".join(f"'{x}'" for x in cfg.exclude_sources)
    broken = ", ".join(f"CASE WHEN {t} THEN '{name}' END" for t, name in zip(tests, labels, strict=True))
    return rf"""
WITH m AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(text, '{text_archive.WORD}'))::DOUBLE AS words, len(regexp_extract_all(text, '\p{{L}}')) / nullif(length(text), 0)::DOUBLE AS letters,
         len(regexp_extract_all(text, '[0-9]')) / nullif(length(text), 0)::DOUBLE AS digits, len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10)))::DOUBLE AS own_lines,
         len(regexp_extract_all(text, '{text_archive.WORD}')) / len(string_split(text, chr(10)))::DOUBLE AS line_words
  FROM documents
), j AS (
  SELECT *, coalesce(source IN ({listed}), false) AS listed, list_filter([{broken}], lambda x: x IS NOT NULL) AS failed FROM m
), l AS (SELECT doc_id, max(quality)::BIGINT AS quality FROM labels GROUP BY doc_id)
SELECT j.doc_id, source, lang, CASE WHEN listed THEN 'listed' WHEN len(failed) > 0 THEN 'dropped' ELSE 'accepted' END AS status, array_to_string(failed, '; ') AS failed,
       round(words, 6) AS words, round(letters, 6) AS letters, round(digits, 6) AS digits, round(own_lines, 6) AS own_lines, round(line_words, 6) AS line_words, quality
FROM j LEFT JOIN l ON j.doc_id = l.doc_id
"""


ORACLES: dict[str, str] = {"job1_daily_products": _job1_sql(daily_products.settings()), "job2_text_archive": _job2_sql(text_archive.settings())}
