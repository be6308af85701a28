"""Records of series: long metrics to one row, quality thresholds, blanked seasons, and the report on them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flags that older runs lack, and what they count as.
FLAG_DEFAULTS = {"resolution_change_detected": 0.0, "noon_only_applied": 0.0, "resolution_change_doy": None, "noon_only_gate_config": 0.0}
SEASON_LENGTH = ("GCC_3D_p90-season_length", "GCC_3D_p90-GU_50", "GCC_3D_p90-GD_25")


def gather(metrics: DataFrame, keys: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """``keys, metrics MAP<STRING, DOUBLE>``: a key is in the map if the series has a row for it, null and NaN kept apart."""
    entries = F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(name).alias("k"), F.col(value).cast("double").alias("v")))))
    return metrics.groupBy(*keys).agg(entries.alias("metrics"))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, where ``value`` is computed once however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def with_defaults(records: DataFrame, column: str = "metrics") -> DataFrame:
    """Absent flags get their defaults, and the season's length is derived (null unless both its dates are there)."""
    absent = F.create_map(*[x for k, v in FLAG_DEFAULTS.items() for x in (F.lit(k), F.lit(v).cast("double"))])
    length, up, down = SEASON_LENGTH

    def filled(m: Column) -> Column:
        derived = F.create_map(F.lit(length), F.try_element_at(m, F.lit(down)) - F.try_element_at(m, F.lit(up)))
        return F.map_concat(F.map_filter(m, lambda k, _: k != length), F.map_filter(absent, lambda k, _: ~F.map_contains_key(m, k)), derived)

    return records.withColumn(column, let(F.col(column), filled))


def rule(key: str, bound: float | None = None, is_min: bool = True, nan_ok: bool = False) -> Column:
    """A bound of a metric, or without one that it must be there, as a row of data: many rules don't make a plan long."""
    return F.struct(F.lit(key).alias("key"), F.lit(bound).cast("double").alias("bound"), F.lit(is_min).alias("is_min"), F.lit(nan_ok).alias("nan_ok"))


def metric_values(key: str | Column, metrics: str | Column = "metrics") -> Column:
    """The values that a key covers in a row: its own, else those of all metrics that end in "-" and the key."""
    m, k = F.col(metrics) if isinstance(metrics, str) else metrics, F.lit(key)
    return F.when(F.map_contains_key(m, k), F.array(F.try_element_at(m, k))).otherwise(F.map_values(F.map_filter(m, lambda name, _: name.endswith(F.concat(F.lit("-"), k)))))


def broken(rule: Column, metrics: str | Column = "metrics") -> Column:
    """Whether a row breaks a rule.

    A bound: no value or null breaks it unless ``nan_ok``; NaN doesn't. Without a bound: no value, null and NaN break it.
    """

    def bad(v: Column) -> Column:
        beyond = F.when(rule["is_min"], v < rule["bound"]).otherwise(v > rule["bound"])
        return F.when(v.isNull(), ~rule["nan_ok"]).when(F.isnan(v), rule["bound"].isNull()).otherwise(F.coalesce(beyond, F.lit(False)))

    return let(metric_values(rule["key"], metrics), lambda values: F.when(F.size(values) == 0, ~rule["nan_ok"]).otherwise(F.exists(values, bad)))


def fails(key: str, bound: float, is_min: bool, nan_ok: bool = False, metrics: str | Column = "metrics") -> Column:
    """Whether a row violates a bound, see :func:`broken`."""
    return broken(rule(key, bound, is_min, nan_ok), metrics)


def lacks(key: str, metrics: str | Column = "metrics") -> Column:
    """Whether a row has no value, a null or a NaN for a required key."""
    return broken(rule(key), metrics)


def season_of(key: str) -> str:
    """The part of the year that a threshold judges."""
    for name, letter in (("spring", "U"), ("autumn", "D")):
        if key.startswith(f"{name}_") or re.search(rf"-[A-Z]{letter}_", key):
            return name
    return "whole_year"


def blanked(metrics: Column, spring: Column, autumn: Column) -> Column:
    """NaN for every metric of a season (``-GU_`` or ``-GD_`` in its name) that isn't ok."""
    return F.transform_values(metrics, lambda k, v: F.when((k.contains("-GU_") & ~spring) | (k.contains("-GD_") & ~autumn), F.lit(float("nan"))).otherwise(v))


@dataclass
class Rules:
    """Bounds and other rules that records are filtered by."""

    min_thresholds: dict[str, float] = field(default_factory=dict)
    max_thresholds: dict[str, float] = field(default_factory=dict)
    nan_ok_keys: list[str] = field(default_factory=list)
    required_keys: list[str] = field(default_factory=list)
    allow_partial: bool = True

    def bounds(self) -> list[tuple[str, float, bool]]:
        return [*((k, b, True) for k, b in self.min_thresholds.items()), *((k, b, False) for k, b in self.max_thresholds.items())]

    def failures(self, metrics: str | Column = "metrics") -> Column:
        """Whether a row breaks each rule: an array in the order of :func:`rule_labels`."""
        rules = [*(rule(k, b, is_min, k in self.nan_ok_keys) for k, b, is_min in self.bounds()), *map(rule, self.required_keys)]
        return F.transform(F.array(*rules), lambda r: broken(r, metrics)) if rules else F.array().cast("array<boolean>")


def judged(records: DataFrame, rules: Rules, excluded: DataFrame | None = None, keys: tuple[str, ...] = ("uid", "year"), column: str = "metrics") -> DataFrame:
    """Adds ``by_list`` (on the exclusion list ``keys``), ``failed``, ``dropped``, ``spring_ok``, ``autumn_ok`` and ``accepted``.

    ``failed`` says for each rule whether the row breaks it, in the order of :func:`rule_labels`. A rule is evaluated once
    a row: seasons, the report and blanking read what it gave.
    """
    if excluded is not None:
        listed = excluded.select(*keys).distinct().withColumn("_x", F.lit(True))
        records = records.join(listed, list(keys), "left").withColumn("by_list", F.coalesce("_x", F.lit(False))).drop("_x")
    else:
        records = records.withColumn("by_list", F.lit(False))
    places: dict[str, list[int]] = {"whole_year": [], "spring": [], "autumn": []}
    for i, (key, _, _) in enumerate(rules.bounds()):
        places[season_of(key)].append(i)
    places["whole_year"] += range(len(rules.bounds()), len(rules.bounds()) + len(rules.required_keys))

    def verdict(failed: Column) -> Column:
        ok = {name: reduce(lambda a, b: a & b, [~F.get(failed, F.lit(i)) for i in own], F.lit(True)) for name, own in places.items()}
        seasons = (ok["spring"] | ok["autumn"]) if rules.allow_partial else (ok["spring"] & ok["autumn"])
        return F.struct(failed.alias("failed"), (ok["whole_year"] & seasons).alias("keep"), ok["spring"].alias("spring"), ok["autumn"].alias("autumn"))

    records = records.withColumn("_verdict", let(rules.failures(column), verdict))
    listed, keep = F.col("by_list"), F.col("_verdict.keep")
    return records.withColumns({
        "failed": F.col("_verdict.failed"), "dropped": ~listed & ~keep, "spring_ok": F.col("_verdict.spring"), "autumn_ok": F.col("_verdict.autumn"), "accepted": ~listed & keep,
    }).drop("_verdict")


def filtered(judged_records: DataFrame, column: str = "metrics") -> DataFrame:
    """Accepted records, failing seasons blanked."""
    kept = judged_records.where("accepted").withColumn(column, blanked(F.col(column), F.col("spring_ok"), F.col("autumn_ok")))
    return kept.drop("by_list", "failed", "dropped", "accepted", "spring_ok", "autumn_ok")


def counts(judged_records: DataFrame, rules: Rules) -> DataFrame:
    """One row of counts: totals, and how many records each rule alone would exclude (``rule_<i>``)."""
    n = lambda c: F.count_if(c).cast("long")
    accepted = F.col("accepted")
    return judged_records.agg(
        F.count(F.lit(1)).alias("total"), n(F.col("dropped")).alias("excluded"), n(F.col("by_list")).alias("listed"),
        n(accepted & ~F.col("spring_ok")).alias("spring_removed"), n(accepted & ~F.col("autumn_ok")).alias("autumn_removed"),
        *[n(F.get("failed", F.lit(i))).alias(f"rule_{i}") for i in range(len(rules.bounds()) + len(rules.required_keys))],
    )


def rule_labels(rules: Rules) -> list[str]:
    out = []
    for key, bound, is_min in rules.bounds():
        part = season_of(key)
        out.append(f"{'min' if is_min else 'max'}  {key} {'>=' if is_min else '<='} {bound}" + (f" [{part}]" if part != "whole_year" else ""))
    return out + [f"req  {k} present" for k in rules.required_keys]


def report(row: dict, rules: Rules) -> str:
    """The filtering report as text, from the counted row."""
    total, partial = row["total"], row["spring_removed"] + row["autumn_removed"]
    share = lambda n: f"{n / total * 100:.1f}" if total else "N/A"
    entries = [
        ("Fully accepted         ", total - row["excluded"] - row["listed"] - partial, False), ("Partially accepted     ", partial, True),
        ("  - Spring removed (GU NaN) ", row["spring_removed"], True), ("  - Autumn removed (GD NaN) ", row["autumn_removed"], True),
        ("Excluded (thresholds)  ", row["excluded"], True), ("Excluded (external CSV)", row["listed"], True),
    ]
    rule = "-" * 78
    mode = "partial (failing season blanked)" if rules.allow_partial else "hard (failing season excludes the tree-year)"
    text = ["Filtering Report", "=" * 16, f"Total tree-years found : {total}"]
    text += [f"{label}: {n:>3} ({share(n)} %)" if wide else f"{label}: {n} ({share(n)} %)" for label, n, wide in entries]
    text += ["", f"Per-season filters     : {mode}", "", "Per-filter exclusions (independent counts — a tree-year may appear in multiple):"]
    text += [rule, f"  {'Filter':<55}  {'Excluded':>8}  {'%':>6}", rule]
    text += [f"  {label:<55}  {row[f'rule_{i}']:>8d}  {share(row[f'rule_{i}']):>6} %" for i, label in enumerate(rule_labels(rules))]
    return "\n".join([*text, rule]) + "\n"


def widen(records: DataFrame, names: list[str], keep: list[str], column: str = "metrics", nan_as_null: bool = False) -> DataFrame:
    """One column a metric, from an explicit list; for CSV, where NaN is an empty field, with ``nan_as_null``."""

    def of(name: str) -> Column:
        v = F.try_element_at(F.col(column), F.lit(name))
        return F.when(~F.isnan(v), v) if nan_as_null else v

    return records.select(*keep, *[of(n).alias(n) for n in names])


def metric_names(indices: list[str], windows: list[str], strategies: list[str], thresholds: tuple[float, ...]) -> list[str]:
    """All metric names of the given products: dates and their deviations, then scalars."""
    out = []
    for i in indices:
        dates = ["PEAK", *(f"{i[0]}{d}_{round(t * 100)}" for t in thresholds for d in "UD")]
        for w in windows:
            for s in strategies:
                names = [*dates, *(f"{d}-std" for d in dates), "amplitude", "baseline", "peak_value", "window_selected", "noise_std", "snr", "n_peak"]
                out += [f"{i}_{w}_{s}-{n}" for n in names]
    return out + [SEASON_LENGTH[0]]
