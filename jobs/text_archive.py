"""A text archive judged by thresholds, as series are: metrics of each text, rules, what was kept, and the report on the rules.

    python -m jobs.text_archive --documents PATH --labels PATH --out FOLDER [--config jobs/text_archive.json]

``out/records`` has one row a document with its metrics and status, by status and language; ``out/report`` has counts, by language.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyspark.operators import records

log = logging.getLogger("jobs.text_archive")

METRICS = ["words", "letters", "digits", "own_lines", "line_words"]
WORD = r"[^\x20\x09-\x0D]+"
RECORD = f"doc_id long, source string, lang string, failed array<string>, {', '.join(f'{m} double' for m in METRICS)}, quality int, status string, language string"


@dataclass
class Settings:
    """Bounds by metric, metrics that may be absent or must be there, and sources that are left out whatever their texts."""

    min_thresholds: dict[str, float] = field(default_factory=dict)
    max_thresholds: dict[str, float] = field(default_factory=dict)
    nan_ok_keys: list[str] = field(default_factory=list)
    required_keys: list[str] = field(default_factory=list)
    exclude_sources: list[str] = field(default_factory=list)

    def rules(self) -> records.Rules:
        return records.Rules(self.min_thresholds, self.max_thresholds, self.nan_ok_keys, self.required_keys)


def settings(path: str | Path = Path(__file__).with_suffix(".json")) -> Settings:
    return Settings(**json.loads(Path(path).read_text()))


def with_metrics(documents: DataFrame) -> DataFrame:
    """``doc_id, source, lang`` and a text's metrics by name: words, shares of letters and of digits in its code points, share of different lines, words a line.

    A null text has none of them and an empty one no shares; "lang" is there where the language is known.
    """
    text = F.col("text")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    counts = {"_words": count(WORD), "_letters": count(r"\p{L}"), "_digits": count("[0-9]"), "_chars": F.nullif(F.char_length(text), F.lit(0)), "_lines": F.split(text, "\n", -1)}
    counted = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *[c.alias(n) for n, c in counts.items()])
    n = F.size("_lines")
    values = {"words": F.col("_words"), "letters": F.col("_letters") / F.col("_chars"), "digits": F.col("_digits") / F.col("_chars"), "own_lines": F.size(F.array_distinct("_lines")) / n, "line_words": F.col("_words") / n}
    entries = [F.when(F.col("_words").isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in values.items()]
    entries.append(F.when(F.col("lang").isNotNull(), F.struct(F.lit("lang").alias("k"), F.lit(1.0).alias("v"))))
    return counted.select("doc_id", "source", "lang", F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("metrics"))


def judge(documents: DataFrame, labels: DataFrame, cfg: Settings) -> DataFrame:
    """``doc_id, source, lang``, the metrics as columns, ``quality`` (the label, if there is one), ``status`` and ``failed``, the rules broken.

    Status: "listed" for an excluded source, else "dropped" or "accepted". Each row is judged by itself; of several labels
    of a document the highest counts.
    """
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    listed = F.coalesce(F.col("source").isin(cfg.exclude_sources), F.lit(False))
    judged = records.judged(with_metrics(documents).withColumn("listed", listed), cfg.rules())
    names = F.array(*map(F.lit, records.rule_labels(cfg.rules()))).cast("array<string>")
    broken = F.filter(names, lambda _, i: F.get("failed", i))
    status = F.when(F.col("listed"), "listed").when(F.col("dropped"), "dropped").otherwise("accepted")
    flat = records.widen(judged.withColumns({"status": status, "failed": broken}), METRICS, ["doc_id", "source", "lang", "status", "failed"])
    return flat.join(one, "doc_id", "left")


def report(judged: DataFrame, cfg: Settings) -> DataFrame:
    """One row a language and rule: ``documents, accepted, listed, failed`` (the rule alone), and of the accepted those with a label and a good one."""
    n = lambda c: F.count_if(c).alias
    labels = records.rule_labels(cfg.rules())
    accepted = F.col("status") == "accepted"
    counted = judged.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), n(accepted)("accepted"), n(F.col("status") == "listed")("listed"), n(accepted & F.col("quality").isNotNull())("labelled"), n(accepted & (F.col("quality") == 1))("good"),
        F.array(*[F.count_if(F.array_contains("failed", x)) for x in labels]).alias("_failed"),
    )
    return counted.select("lang", "documents", "accepted", "listed", "labelled", "good", F.explode(F.arrays_zip(F.array(*map(F.lit, labels)).alias("rule"), F.col("_failed").alias("failed"))).alias("r")).select("lang", "r.rule", "r.failed", "documents", "accepted", "listed", "labelled", "good")


def read(spark: SparkSession, out: str) -> DataFrame:
    """The records as they stand."""
    return spark.read.schema(RECORD).parquet(f"{out}/records")


def run(spark: SparkSession, documents: str, labels: str, out: str, cfg: Settings | None = None) -> dict[str, int]:
    """Judge all documents and write both tables anew; returns counts. A run again gives the same rows.

    Rows of a status and language lie together and are split where they are many, so that one language with most of the
    rows is written by many tasks. The report is counted from the records as written.
    """
    cfg = cfg or settings()
    found = judge(spark.read.parquet(documents), spark.read.parquet(labels), cfg)
    found.withColumn("language", F.coalesce("lang", F.lit("unknown"))).hint("rebalance", "status", "language").write.partitionBy("status", "language").mode("overwrite").parquet(f"{out}/records")
    written = read(spark, out)
    report(written, cfg).coalesce(1).write.mode("overwrite").parquet(f"{out}/report")
    counts = {r.status: r["count"] for r in written.groupBy("status").count().collect()}
    log.info("%s: read %d documents; %s: %s", documents, sum(counts.values()), out, counts)
    return counts


def main(arguments: list[str] | None = None) -> None:
    from canopyspark.session import session

    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "labels", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO)
    spark = session("text archive")
    try:
        run(spark, given.documents, given.labels, given.out, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
