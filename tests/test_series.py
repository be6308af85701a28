"""Filters, products, sampling, smoothing, transitions: scenarios and brute force."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyspark.operators import filters, montecarlo, resample, sampling, smooth, transitions

KEYS = ["uid"]


def bump(doy):
    return 0.3 + 0.1 * np.exp(-((doy - 180) ** 2) / (2 * 40**2))


def frame(spark, rows, schema="uid string, ts timestamp_ntz, value double"):
    return spark.createDataFrame(rows, schema)


def year_rows(year=2020, days=365, uid="a"):
    start = datetime(year, 1, 1)
    return [(uid, start + timedelta(days=i), float(bump(i + 1))) for i in range(days)]


def test_brightness_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(49.9,), (50.0,), (650.0,), (650.1,), (float("nan"),), (None,)], "brightness double")
    assert sorted(r[0] for r in filters.brightness_filter(df).collect()) == [50.0, 650.0]


def test_snow_nulls_values_and_keeps_rows(spark):
    df = spark.createDataFrame([("x", datetime(2020, 1, d, h), 1.0) for d in (1, 2, 3) for h in (6, 12)], "location string, ts timestamp_ntz, v double")
    snow = spark.createDataFrame([("x", date(2020, 1, 1), 1), ("x", date(2020, 1, 2), 1), ("x", date(2020, 1, 3), 0)], "location string, date date, snow int")
    out = filters.mask_snow(df, snow, ["v"]).toPandas()
    assert len(out) == 6 and out.v.notna().sum() == 2 and set(out[out.v.notna()].ts.dt.day) == {3}


@pytest.mark.parametrize("strategy", resample.STRATEGIES)
def test_daily_product_has_every_day(spark, strategy):
    rows = [r for r in year_rows() if r[1].day != 15]
    out = resample.daily_product(frame(spark, rows), KEYS, strategies=(strategy,)).toPandas()
    assert len(out) == 365 and out[strategy].isna().sum() == 12


def test_bins_start_at_day_two(spark):
    rows = [("a", datetime(2020, 1, 1), 99.0), *[(u, t, 0.0) for u, t, _ in year_rows()[1:]]]
    out = resample.binned_product(frame(spark, rows), KEYS, 3).toPandas().sort_values("doy")
    assert out.avg.max() == 0 and out.doy.iloc[0] == 2 and (np.diff(out.doy) == 3).all() and 120 <= len(out) <= 122
    assert out.date.iloc[0] == date(2020, 1, 2)


def test_leap_year_ends_in_bin_365(spark):
    out = resample.binned_product(frame(spark, year_rows(2020, 366)), KEYS, 3).toPandas()
    assert out.doy.max() == 365 and out[out.doy == 365].avg.notna().all()


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("a", datetime(2021, 5, 1, 6) + timedelta(minutes=int(m)), float(v)) for m, v in zip(rng.integers(0, 600, 40), rng.normal(size=40), strict=True)]
    out = resample.daily_product(frame(spark, rows), KEYS).toPandas().iloc[0]
    values = [r[2] for r in rows]
    assert out.avg == pytest.approx(np.mean(values)) and out.p90 == pytest.approx(np.quantile(values, 0.9)) and out.p50 == pytest.approx(np.median(values))


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="p99"):
        resample.daily_product(frame(spark, year_rows()), KEYS, strategies=("p99",))


def test_gap_of_three_days_has_length_four(spark):
    rows = [("a", datetime(2020, 1, d, 12), 1.0) for d in range(1, 31) if d not in (16, 17, 18)]
    out = sampling.sampling_flags(frame(spark, rows), KEYS).first()
    assert out.n_gaps == 1 and out.gap_lengths_day == [4] and out.gap_start_dates == ["2020-01-16"]
    assert out.spring_coverage_ratio == 0 and out.spring_max_gap_days == 101 and out.spring_n_gaps == 1


def test_longest_missing_run_counts_season_ends(spark):
    start = datetime(2021, 1, 1)
    rows = [("a", start + timedelta(days=d - 1, hours=12), 1.0) for d in range(60, 161) if not 90 <= d <= 96]
    rows += [("b", start + timedelta(days=d - 1), 1.0) for d in (70, 71)]
    out = {r.uid: r for r in sampling.sampling_flags(frame(spark, rows), KEYS).collect()}
    assert out["a"].spring_max_consecutive_missing_days == 7 and out["a"].spring_coverage_ratio == pytest.approx(94 / 101)
    assert out["b"].spring_max_consecutive_missing_days == 89 and out["b"].spring_max_gap_days == 1


def test_span_counts_whole_days(spark):
    out = sampling.sampling_flags(frame(spark, [("a", datetime(2020, 3, 1, 6), 1.0), ("a", datetime(2020, 3, 2, 5), 1.0)]), KEYS).first()
    assert out.avg_obs_per_day == 2 and out.max_obs_per_day == 1


def counts_rows(counts, uid="a"):
    return [(uid, datetime(d.year, d.month, d.day, 6) + timedelta(hours=i * (12 // n)), 1.0) for d, n in counts.items() for i in range(n)]


@pytest.mark.parametrize("year", [2020, 2021])
def test_step_is_found(spark, year):
    days = pd.date_range(f"{year}-01-01", f"{year}-12-31")
    july = pd.Timestamp(f"{year}-07-01")
    out = sampling.step_detector(frame(spark, counts_rows({d: 1 if d < july else 5 for d in days})), KEYS).first()
    assert out.detected and out.reason is None and abs(out.best_doy - july.dayofyear) <= 15 and out.med_before == 1 and out.med_after == 5


def test_uniform_rates_are_no_step(spark):
    days = pd.date_range("2021-01-01", "2021-12-31")
    rng = np.random.default_rng(42)
    rows = counts_rows(dict.fromkeys(days, 5), "five") + counts_rows(dict.fromkeys(days, 1), "one") + counts_rows({d: int(rng.integers(1, 6)) for d in days}, "any")
    out = {r.uid: r for r in sampling.step_detector(frame(spark, rows), KEYS).collect()}
    assert not any(r.detected for r in out.values())
    assert out["five"].reason == out["one"].reason == "pre_filter" and out["five"].best_doy is None


def test_change_point_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 2, 40), rng.integers(2, 5, 33)])
    out = sampling.change_point(spark.createDataFrame([("a", i, int(v)) for i, v in enumerate(x)], "uid string, doy int, n int"), KEYS).first()
    n = len(x)
    stat = [abs(x[k:].mean() - x[:k].mean()) * np.sqrt(k * (n - k) / n) for k in range(1, n)]
    assert out.k == 1 + int(np.argmax(stat)) and out.stat == pytest.approx(max(stat))


def test_closest_to_noon(spark):
    rows = [("a", datetime(2020, 5, 1, h), 0.0) for h in (6, 9, 12, 15, 18)] + [("a", datetime(2020, 5, 2, h), 0.0) for h in (10, 14)] + [("a", datetime(2020, 5, 3, h), 0.0) for h in (8, 12, 12, 16)]
    out = sorted(r.ts for r in sampling.closest_to_noon(frame(spark, rows), KEYS).collect())
    assert [(t.day, t.hour) for t in out] == [(1, 12), (2, 10), (3, 12), (3, 12)]


def brute_cv(signal, candidates, folds=5, seed=42):
    n, fold, best = len(signal), smooth.fold_ids(len(signal), folds, seed), (np.inf, None)
    for w in candidates:
        errors = []
        for f in range(folds):
            temp = np.where(fold == f, np.nan, signal)
            sq = [(signal[i] - np.nanmean(part)) ** 2 for i in np.flatnonzero(fold == f) if (~np.isnan(part := temp[max(0, i - w // 2) : i + w // 2 + 1])).any()]
            if sq:
                errors.append(np.mean(sq))
        if errors and np.mean(errors) < best[0]:
            best = (np.mean(errors), w)
    return best[1]


def test_folds_are_those_of_a_shuffled_k_fold():
    ids = smooth.fold_ids(12, 5)
    order = np.random.RandomState(42).permutation(12)
    assert [sorted(np.flatnonzero(ids == f)) for f in range(5)] == [sorted(p) for p in np.split(order, [3, 6, 8, 10])]


def test_cv_window_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, signals = [], {}
    for i in range(12):
        n = int(rng.integers(5, 90))
        s = bump(np.linspace(1, 365, n)) + rng.normal(0, 0.02, n)
        signals[f"s{i}"] = s
        rows += [(f"s{i}", date(2020, 1, 1) + timedelta(days=j), float(v)) for j, v in enumerate(s)]
        rows += [(f"s{i}", date(2019, 12, 31), None)]
    rows += [("short", date(2020, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "uid string, date date, v double")
    out = {r.uid: r.best for r in smooth.cv_window(df, KEYS, "v", [3, 5, 7, 9]).collect()}
    assert out == {k: brute_cv(s, [3, 5, 7, 9]) for k, s in signals.items()}
    smoothed = smooth.cv_smooth(df, KEYS, "v", [3, 5, 7, 9]).where("uid = 's0'").orderBy("date").toPandas()
    whole = pd.Series([np.nan, *signals["s0"]]).rolling(out["s0"], center=True, min_periods=1).mean()
    whole[0] = np.nan
    np.testing.assert_allclose(smoothed.smoothed, whole, atol=1e-10)


def test_rolling_mean_keeps_nulls(spark):
    rows = [("a", date(2020, 1, 1) + timedelta(days=i), None if 90 <= i <= 94 else float(bump(i + 1))) for i in range(365)]
    out = smooth.rolling_mean(spark.createDataFrame(rows, "uid string, date date, v double"), KEYS, "v", 7).orderBy("date").toPandas()
    assert list(np.flatnonzero(out.smoothed.isna())) == [90, 91, 92, 93, 94]


def crossing_loop(doy, v, thresholds, low=60, high=320):
    v = pd.Series(v).interpolate(limit_direction="both").to_numpy()
    keep = (doy >= low) & (doy <= high)
    d, v = doy[keep].astype(float), v[keep]
    p, base = int(np.argmax(v)), v.min()
    out = {"PEAK": d[p]}
    for t in thresholds:
        level = base + t * (v[p] - base)
        found = {"U": None, "D": None}
        for i in range(len(v) - 1):
            step = np.sign(v[i + 1] - level) - np.sign(v[i] - level)
            day = d[i] + (d[i + 1] - d[i]) * (level - v[i]) / (v[i + 1] - v[i]) if v[i + 1] != v[i] else d[i]
            if i < p and step > 0:
                found["U"] = day
            if i >= p and step < 0 and found["D"] is None:
                found["D"] = day
        for k, x in found.items():
            out[f"G{k}_{round(t * 100)}"] = x
    return out


def test_transitions_match_a_loop(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for i in range(15):
        doy = np.arange(2, 366, 3)
        v = bump(doy) + rng.normal(0, 0.02, len(doy))
        v[rng.random(len(doy)) < 0.1] = np.nan
        want[f"s{i}"] = crossing_loop(doy, v, transitions.THRESHOLDS)
        rows += [(f"s{i}", date(2021, 1, 1) + timedelta(days=int(d) - 1), int(d), None if np.isnan(x) else float(x)) for d, x in zip(doy, v, strict=True)]
    rows += [("winter", date(2021, 1, d), d, 1.0) for d in range(1, 30)]
    df = spark.createDataFrame(rows, "uid string, date date, doy int, smoothed double")
    out = {r.uid: r for r in transitions.transitions(df, KEYS).collect()}
    assert set(out) == set(want)
    for k, dates in want.items():
        for name, day in dates.items():
            assert out[k].dates[name] == (pytest.approx(day, abs=1e-6) if day is not None else None), (k, name)


def test_flat_series_has_no_crossing(spark):
    df = spark.createDataFrame([("a", date(2021, 1, 1) + timedelta(days=i), i + 1, 0.5) for i in range(365)], "uid string, date date, doy int, smoothed double")
    out = transitions.transitions(df, KEYS).first()
    assert out.amplitude == 0 and out.dates["GU_50"] is None and out.dates["PEAK"] == 60


def test_extrema_and_cycles(spark):
    x = np.sin(np.linspace(0, 4 * np.pi, 100))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "uid string, date int, v double")
    s = pd.Series(x)
    mark = np.sign(s.diff()).diff() != 0
    kept = s[mark].dropna().iloc[1:]
    out = transitions.extrema(df, KEYS, "v").orderBy("at").toPandas()
    np.testing.assert_allclose(out["value"], kept.iloc[:-1])
    np.testing.assert_allclose(out.amplitude, np.abs(np.diff(kept)))
    amplitudes = spark.createDataFrame([("a", 2.0)], "uid string, amplitude double")
    assert transitions.cycles(df, KEYS, "v", amplitudes).first().n_peak == int(((kept.shift(-1) - kept).dropna() > 1).sum())


def test_snr_of_perfect_and_flat_signals(spark):
    rows = [("perfect", float(i), float(i)) for i in range(4)] + [("flat", float(i), 0.0) for i in range(4)] + [("mixed", float(i + i % 2), float(i)) for i in range(4)]
    out = {r.uid: r for r in transitions.signal_quality(spark.createDataFrame(rows, "uid string, raw double, s double"), KEYS, "raw", "s").collect()}
    assert out["perfect"].snr == float("inf") and out["flat"].snr == float("-inf")
    assert out["mixed"].snr == pytest.approx(10 * np.log10(np.var([0, 1, 2, 3]) / np.var([0, 1, 0, 1])))


def test_interpolation_by_row_and_by_day(spark):
    rows = [("a", 1, None), ("a", 2, 1.0), ("a", 5, None), ("a", 6, 3.0), ("a", 9, None)]
    df = spark.createDataFrame(rows, "uid string, doy int, v double")
    by_row = [r.filled for r in transitions.interpolate(df, KEYS, "v", "doy").orderBy("doy").collect()]
    by_day = [r.filled for r in transitions.interpolate(df, KEYS, "v", "doy", by="doy", edges=False).orderBy("doy").collect()]
    assert by_row == [1.0, 1.0, 2.0, 3.0, 3.0] and by_day == [None, 1.0, 2.5, 3.0, None]


def test_monte_carlo_matches_sequential_simulation(spark):
    doy = np.arange(2, 366, 6)
    rng = np.random.default_rng(0)
    raw = bump(doy) + rng.normal(0, 0.005, len(doy))
    s = pd.Series(raw).rolling(5, center=True, min_periods=1).mean().to_numpy()
    rows = [("a", date(2021, 1, 1) + timedelta(days=int(d) - 1), int(d), float(r), float(x)) for d, r, x in zip(doy, raw, s, strict=True)]
    df = spark.createDataFrame(rows, "uid string, date date, doy int, raw double, s double")
    run = lambda: montecarlo.uncertainties(df, KEYS, "raw", "s", [3, 5, 7], seed=11, iterations=12, folds=3).first()
    one, two = run(), run()
    assert one == two and one.GU_50_std > 0
    noise = np.random.default_rng(np.random.SeedSequence(11).spawn(1)[0])
    sigma, found = float(np.sqrt(np.mean((raw - s) ** 2))), []
    for _ in range(12):
        noisy = s + noise.normal(0, sigma, len(s))
        w = brute_cv(noisy, [3, 5, 7], 3)
        found.append(crossing_loop(doy, pd.Series(noisy).rolling(w, center=True, min_periods=1).mean().to_numpy(), transitions.THRESHOLDS))
    want = pd.DataFrame(found).astype(float).std()
    assert one.noise_std == pytest.approx(sigma)
    for k in want.index:
        assert one[f"{k}_std"] == pytest.approx(want[k], abs=1e-8)


def test_modal_shape_prefers_larger_area_on_ties(spark):
    rows = [("x", f"p{i}", h, w) for i, (h, w) in enumerate([(10, 10), (10, 10), (20, 20), (20, 20), (5, 5)])]
    df = spark.createDataFrame(rows, "site string, path string, height int, width int")
    assert filters.modal_shape(df, ["site"]).first()[1:] == (20, 20)
    assert filters.of_shape(df, filters.modal_shape(df, ["site"]), ["site"]).count() == 2


def test_empty_series(spark):
    empty = frame(spark, [])
    for out in (resample.daily_product(empty, KEYS), resample.binned_product(empty, KEYS), sampling.sampling_flags(empty, KEYS), sampling.step_detector(empty, KEYS)):
        assert out.count() == 0


def test_monte_carlo_query_makes_a_thousand_copies(spark, sf):
    from canopyspark.plans import catalog

    found = catalog.QUERIES["monte_carlo"](spark, sf).orderBy("uid", "year").first()
    smoothed = smooth.rolling_mean(catalog._bins(spark, sf), catalog.TREE, "p90", 7, "doy")
    want = montecarlo.uncertainties(smoothed, catalog.TREE, "p90", "smoothed", [3, 5, 7, 9], seed=7, iterations=1000, order="doy").orderBy("uid", "year").first()
    assert found.asDict().keys() == want.asDict().keys()
    np.testing.assert_allclose(list(found), list(want), rtol=1e-6)


def test_sampling_flags_see_a_row_a_date(spark):
    """However many rows a date has, one of them is exchanged for windows; steps between rows of a date are none."""
    times = F.timestamp_seconds(F.lit(1583020800) + F.col("id") % 80_000 + (F.col("id") % 2) * 3 * 86_400)  # 2020-03-01 and 2020-03-04
    rows = spark.range(0, 200_000, 1, 4).select(F.lit("a").alias("uid"), F.lit(2020).alias("year"), times.alias("ts"))
    size = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = size()
    out = sampling.sampling_flags(rows, ["uid", "year"]).first()
    assert size() - before < 50_000
    assert (out.n_gaps, out.gap_lengths_day, out.gap_start_dates) == (1, [3], ["2020-03-02"])
    assert (out.max_obs_per_day, out.min_obs_per_day, out.avg_obs_per_day) == (100_000, 100_000, 50_000.0)
    assert (out.spring_max_gap_days, out.spring_n_gaps, out.spring_coverage_ratio, out.spring_max_consecutive_missing_days) == (3, 1, 2 / 101, 96)
    one = sampling.sampling_flags(rows.where("id % 2 = 0"), ["uid", "year"]).first()
    assert (one.spring_max_gap_days, one.spring_n_gaps, one.n_gaps) == (0, 0, 0)
