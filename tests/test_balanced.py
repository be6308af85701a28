"""Balanced means against brute force, where keys repeat and rows are equal; folds of long series."""

import hashlib
import statistics
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest

from canopyspark.operators import analytics, smooth

SCHEMA = "band string, species string, uid long, v double"


def brute(rows, draws=100, seed=0):
    strata = defaultdict(list)
    for (band, species, uid, v), m in Counter(r for r in rows if r[0] is not None and r[1] is not None).items():
        strata[band, species] += [(uid, v, i) for i in range(1, m + 1)]
    n = min(map(len, strata.values()))
    means = defaultdict(list)
    for draw in range(draws):
        taken = defaultdict(list)
        for (_, species), own in strata.items():
            lot = lambda r: hashlib.md5("|".join([str(seed), str(draw), *(str(x) for x in r if x is not None)]).encode()).hexdigest()
            taken[species] += [v for _, v, _ in sorted(own, key=lot)[:n] if v is not None]
        for species, vs in taken.items():
            means[species].append(statistics.fmean(vs))
    return {s: statistics.fmean(m) for s, m in means.items()}


def means(spark, rows, **more):
    out = analytics.balanced_means(spark.createDataFrame(rows, SCHEMA).repartition(3), ["band"], "species", ["v"], **more)
    return {r.species: r.v for r in out.collect()}


@pytest.mark.parametrize("uids", [1, 5, 1000])
def test_every_stratum_counts_the_same(spark, uids):
    """One stratum of 1000 rows of 0 and one of 10 rows of 1: a half, however few keys hold the rows."""
    rows = [("x", "s", i % uids, 0.0) for i in range(1000)] + [("y", "s", i, 1.0) for i in range(10)]
    assert means(spark, rows) == {"s": 0.5}


@pytest.mark.parametrize("case", range(4))
def test_balanced_means_match_brute_force(spark, case):
    rng = np.random.default_rng(case)
    size = [(3, 50), (1, 400), (20, 25), (7, 7)][case]
    rows = []
    for b in "abc":
        for s in ("oak", "elm"):
            n = int(rng.integers(*size, endpoint=True))
            rows += [(b, s, int(rng.integers(0, 4)), float(rng.integers(0, 6)) if rng.random() < 0.9 else None) for _ in range(n)]
    rows += [(None, "oak", 1, 99.0), ("a", None, 1, 99.0)]
    got, want = means(spark, rows, draws=20, seed=3), brute(rows, 20, 3)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_lots_of_the_last_class_count(spark, monkeypatch):
    """However few classes there are, the draw is the same."""
    rows = [("a", "s", i % 3, float(i % 7)) for i in range(300)] + [("b", "s", 1, float(i)) for i in range(9)]
    want = means(spark, rows, draws=10)
    for classes, span in ((1, 0), (50, 1)):
        monkeypatch.setattr(analytics, "CLASSES", classes)
        monkeypatch.setattr(analytics, "SPAN", span)
        assert means(spark, rows, draws=10) == want


def test_balanced_means_of_nothing(spark):
    assert means(spark, [(None, "s", 1, 1.0)]) == {} and means(spark, []) == {}


def test_folds_of_long_series(spark):
    """Series of over two years of days have the folds of any other; a stated longest length is an error beyond it."""
    n = smooth.LONGEST + 70
    values = np.sin(np.arange(n) / 40) + np.random.default_rng(1).normal(0, 0.1, n)
    rows = [("long", date(2020, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values)] + [("short", date(2020, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values[:100])]
    df = spark.createDataFrame(rows, "uid string, date date, v double").repartition(4)
    out = {r.uid: r for r in smooth.cv_window(df, ["uid"], "v", [3, 9, 21]).collect()}
    for uid, own in (("long", values), ("short", values[:100])):
        fold, at = smooth.fold_ids(len(own), 5, 42), np.arange(len(own))
        errors = []
        for w in (3, 9, 21):
            by_fold = []
            for f in range(5):
                gaps = [own[i] - own[near].mean() for i in at[fold == f] if len(near := [j for j in range(max(0, i - w // 2), min(len(own), i + w // 2 + 1)) if fold[j] != f])]
                by_fold.append(np.mean(np.square(gaps)))
            errors.append(np.mean(by_fold))
        assert (out[uid].n, out[uid].best, out[uid].mse) == (len(own), [3, 9, 21][int(np.argmin(errors))], pytest.approx(min(errors)))
    with pytest.raises(Exception, match="more than 732 points"):
        smooth.cv_window(df, ["uid"], "v", [3], longest=smooth.LONGEST).collect()


def test_lots_are_summed_where_they_are(spark):
    """What comes out rests on a kept row a stratum and draw; no window sorts the lots of a stratum as a whole."""
    rows = [("a", "s", i, float(i % 7)) for i in range(600)] + [("b", "s", i, float(i % 5)) for i in range(300)]
    out = analytics.balanced_means(spark.createDataFrame(rows, SCHEMA), ["band"], "species", ["v"], draws=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Window" not in plan and "Generate" not in plan
    assert [r.species for r in out.collect()] == ["s"]
