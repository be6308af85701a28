"""Records: thresholds, blanking, report; analyses on small tables; expressions; geometry."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyspark.functions import chroma, geometry
from canopyspark.functions import expressions as X
from canopyspark.operators import analytics, filters, records

NAN = float("nan")


def table(spark, rows):
    long = [(uid, 2020, k, v) for uid, m in rows.items() for k, v in m.items()]
    return records.gather(spark.createDataFrame(long, "uid string, year int, metric string, value double"), ["uid", "year"])


def flags(spark, rows, column):
    return {r.uid: r.c for r in table(spark, rows).select("uid", column.alias("c")).collect()}


ROWS = {"low": {"A-snr": 1.0}, "high": {"A-snr": 9.0, "B-snr": 8.0}, "one": {"A-snr": 9.0, "B-snr": 1.0}, "null": {"A-snr": None}, "nan": {"A-snr": NAN}, "absent": {"x": 1.0}, "exact": {"snr": 7.0, "A-snr": 1.0}}


def test_bounds_by_exact_and_wildcard_key(spark):
    assert flags(spark, ROWS, records.fails("snr", 6, True)) == {"low": True, "high": False, "one": True, "null": True, "nan": False, "absent": True, "exact": False}
    assert flags(spark, ROWS, records.fails("snr", 6, True, nan_ok=True)) == {"low": True, "high": False, "one": True, "null": False, "nan": False, "absent": False, "exact": False}
    assert flags(spark, ROWS, records.fails("A-snr", 6, False)) == {"low": False, "high": True, "one": True, "null": True, "nan": False, "absent": True, "exact": False}
    assert flags(spark, ROWS, records.lacks("snr")) == {"low": False, "high": False, "one": False, "null": True, "nan": True, "absent": True, "exact": False}


@pytest.mark.parametrize(("key", "season"), [("spring_coverage_ratio", "spring"), ("autumn_n_gaps", "autumn"), ("GCC_3D_p90-GU_50-std", "spring"), ("GCC_3D_p90-GD_25", "autumn"), ("snr", "whole_year"), ("GU_50-std", "whole_year"), ("summer_n_gaps", "whole_year")])
def test_season_of_a_threshold(key, season):
    assert records.season_of(key) == season


def data(spark):
    base = {"GCC_3D_p90-GU_50": 100.0, "GCC_3D_p90-GD_25": 280.0, "GCC_3D_p90-snr": 8.0, "spring_max_consecutive_missing_days": 3.0}
    rows = {"a": base, "b": base | {"spring_max_consecutive_missing_days": 30.0}, "c": base, "d": base | {"GCC_3D_p90-snr": 1.0}, "e": base | {"GCC_3D_p90-GD_25": None}}
    return records.with_defaults(table(spark, rows))


RULES = {"min_thresholds": {"snr": 6}, "max_thresholds": {"spring_max_consecutive_missing_days": 14}}


def test_partial_and_hard_modes(spark):
    excluded = spark.createDataFrame([("c", 2020), ("c", 2020), ("z", 1)], "uid string, year int")
    partial, hard = records.Rules(**RULES), records.Rules(**RULES, allow_partial=False, required_keys=["GCC_3D_p90-GD_25"])
    kept = {r.uid: r.metrics for r in records.filtered(records.judged(data(spark), partial, excluded)).collect()}
    assert set(kept) == {"a", "b", "e"} and math.isnan(kept["b"]["GCC_3D_p90-GU_50"]) and kept["b"]["GCC_3D_p90-season_length"] == 180 and kept["e"]["GCC_3D_p90-season_length"] is None
    assert kept["a"]["resolution_change_detected"] == 0 and kept["a"]["resolution_change_doy"] is None
    assert {r.uid for r in records.filtered(records.judged(data(spark), hard)).collect()} == {"a", "c"}
    counted = records.counts(records.judged(data(spark), partial, excluded), partial).first().asDict()
    assert counted == {"total": 5, "excluded": 1, "listed": 1, "spring_removed": 1, "autumn_removed": 0, "rule_0": 1, "rule_1": 1}
    text = records.report(counted, partial)
    assert "Total tree-years found : 5\n" in text and "Fully accepted         : 2 (40.0 %)" in text and "max  spring_max_consecutive_missing_days <= 14 [spring]" in text
    assert "N/A" in records.report(dict.fromkeys(counted, 0), partial)


def test_explicit_null_flag_is_no_default(spark):
    out = records.with_defaults(table(spark, {"a": {"noon_only_applied": None}})).first().metrics
    assert out["noon_only_applied"] is None and out["resolution_change_detected"] == 0


def test_widen_and_names(spark):
    names = records.metric_names(["GCC"], ["3D"], ["p90"], (0.25, 0.5))
    assert "GCC_3D_p90-GU_50-std" in names and names[-1] == "GCC_3D_p90-season_length"
    wide = records.widen(table(spark, {"a": {"GCC_3D_p90-PEAK": NAN}}), names, ["uid"], nan_as_null=True)
    assert wide.columns == ["uid", *names] and wide.first()["GCC_3D_p90-PEAK"] is None


def test_expressions(spark):
    df = spark.createDataFrame([("I.12", "cam_2022-10-27_1230.jpg"), ("Gp.12345", "2021_0604_120005.png"), ("Q.1", "x_2022-13-40_1230.jpg"), (None, "a.JPG")], "n string, p string")
    out = df.select(X.full_name(F.col("n")).alias("f"), X.picture_time(F.col("p")).alias("t"), X.is_picture(F.col("p")).alias("i")).collect()
    assert [r.f for r in out] == ["Tree0012", "Group12345", None, None]
    assert [r.t for r in out] == [datetime(2022, 10, 27, 12, 30), datetime(2021, 6, 4, 12, 0, 5), None, None]
    assert [r.i for r in out] == [True, False, True, True]
    bands = spark.createDataFrame([(599.0,), (600.0,), (1500.0,), (NAN,), (None,)], "m double").select(X.elevation_band(F.col("m")).alias("b")).collect()
    assert [r.b for r in bands] == ["Low", "Mid", "Very High", None, None]
    one = spark.range(1).select(
        X.site_label(F.lit("A: b "), {"q": "z"}).alias("label"), X.site_label(F.lit("q"), {"q": "z"}).alias("over"), X.product_prefix(F.lit("i1_2020-GCC-3D-p90-transitions"), F.lit("i1_2020")).alias("prefix"),
        X.hex_to_bgr(F.lit("#ff8001")).alias("bgr"), X.half_even(F.lit(2.125).cast("double"), 2).alias("half"), X.compact_name(F.lit("Fagus sylvatica")).alias("short"), X.date_of_doy(F.lit(2020), F.lit(366)).cast("string").alias("d"),
        X.date_key(F.lit("G"), "U", F.lit(0.29)).alias("k"), *X.split_site_year(F.lit("1150_2-2022")),
    ).first()
    assert one == ("b", "z", "GCC_3D_p90", [1, 128, 255], 2.12, "F. sylvatica", "2020-12-31", "GU_29", "1150", "2", "2022")


def test_shoelace_and_extent(spark):
    ring = F.lit([[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]])
    assert spark.range(1).select(X.shoelace(ring), X.extent(ring, 0), X.extent(ring, 1)).first()[:] == (12.0, 4.0, 3.0)


@pytest.mark.parametrize("percent", [33, 29, 57, 80])
def test_convex_polygons_shrink_exactly(percent):
    for ring in ([[0, 0], [20, 0], [20, 20], [0, 20]], [[0, 0], [30, 5], [20, 25]], [[0, 0], [10, 0], [14, 6], [8, 12], [-2, 8]]):
        points = np.array(ring, float)
        out = np.array(geometry.shrink(ring, percent))
        assert geometry.area(out) == pytest.approx(geometry.area(points) * percent / 100, rel=1e-9)
        assert (out[0] == out[-1]).all()


def _star(points, inner, outer):
    turn = np.arange(2 * points) * np.pi / points
    radius = np.where(np.arange(2 * points) % 2, inner, outer)
    return np.stack([50 + radius * np.cos(turn), 50 + radius * np.sin(turn)], 1).tolist()


def _jagged(n, seed):
    rng = np.random.default_rng(seed)
    turn, radius = np.sort(rng.random(n)) * 2 * np.pi, 30 + 10 * rng.random(n)
    return np.stack([100 + radius * np.cos(turn), 100 + radius * np.sin(turn)], 1).tolist()


CONCAVE = {
    "L": [[0, 0], [20, 0], [20, 10], [10, 10], [10, 20], [0, 20]], "U": [[0, 0], [30, 0], [30, 20], [20, 20], [20, 8], [10, 8], [10, 20], [0, 20]], "star": _star(5, 15, 40), "cog": _star(12, 30, 40),
    "spike": [[0, 0], [10, 0], [10, 10], [5, 10], [5, 20], [5, 10], [0, 10]], "jagged": _jagged(15, 1), "more jagged": _jagged(40, 2),
}


@pytest.mark.parametrize("percent", [20, 33, 80])
@pytest.mark.parametrize("name", CONCAVE)
def test_concave_polygons_shrink_exactly(name, percent):
    for ring in (CONCAVE[name], CONCAVE[name][::-1], [*CONCAVE[name], CONCAVE[name][0]]):
        points, out = np.array(CONCAVE[name], float), np.array(geometry.shrink(ring, percent))
        assert geometry.area(out) == pytest.approx(geometry.area(points) * percent / 100, rel=1e-6) and (out[0] == out[-1]).all()
        away = np.full(len(out), np.inf)
        for p, q in zip(points, np.roll(points, -1, 0), strict=True):
            e = q - p
            t = np.clip(((out - p) @ e) / max(e @ e, 1e-300), 0, 1)
            away = np.minimum(away, np.hypot(*(out - p - t[:, None] * e).T))
        assert geometry.inside(points, out[:, 0], out[:, 1]).all()
        assert np.ptp(away) <= away.max() * (1 - np.cos(np.pi / 64)) + 1e-6  # all equally far from the border, but for the chords


def test_a_ring_that_splits_keeps_its_larger_part():
    dumb_bell = [[0, 0], [10, 0], [10, 4], [20, 4], [20, 0], [32, 0], [32, 12], [20, 12], [20, 6], [10, 6], [10, 10], [0, 10]]
    out = np.array(geometry.shrink(dumb_bell, 33))
    assert out[:, 0].min() > 20 and geometry.area(out) == pytest.approx(0.33 * geometry.area(np.array(dumb_bell, float)), rel=1e-6)
    at_the_neck = np.array(geometry.shrink(dumb_bell, 50))  # no distance gives half of it: the last ring that holds together
    assert at_the_neck[:, 0].min() < 10 and at_the_neck[:, 0].max() > 20 and geometry.area(at_the_neck) > 0.5 * 264


def test_degenerate_rings_have_no_shrunk_one():
    assert geometry.shrink([[0, 0], [1, 1]], 33) is None and geometry.shrink([[0, 0], [1, 1], [2, 2]], 33) is None


def test_fill_includes_the_border():
    assert len(geometry.fill([[5.9, 5], [25, 5], [25, 25], [5, 25]], 40, 60)) == 21 * 21
    assert len(geometry.fill([[-5, -5], [3, -5], [3, 3], [-5, 3]], 40, 60)) == 16
    assert len(geometry.fill([[100, 100], [120, 100], [120, 120]], 40, 60)) == 0


def test_ratios_of_constant_and_black_pictures():
    picture = np.broadcast_to(np.array([10, 20, 30], np.uint8), (4, 5, 3)).copy()
    assert chroma.region_ratios(picture, [np.arange(6), np.array([19])]).tolist() == [[20 / 60, 0.5, 10 / 60, 60.0]] * 2
    assert chroma.region_ratios(picture * 0, [np.arange(6)]).tolist() == [[0.0, 0.0, 0.0, 1e-6]]
    with pytest.raises(ValueError, match="outside"):
        chroma.region_ratios(picture, [np.array([20])])


def test_pooled_clipping_per_group(spark):
    df = spark.createDataFrame([("a", float(i), float(i)) for i in range(101)] + [("b", 1000.0, 0.0)], "g string, x double, y double")
    assert filters.clip_pooled(df, "x", "y", keys=("g",)).where("g = 'a'").count() == 97
    assert filters.clip_pooled(df, "x", "y").count() < 102


def test_null_groups_and_full_outer_counts(spark):
    full = spark.createDataFrame([("u", "oak"), ("v", "oak"), ("w", "elm"), ("x", None)], "uid string, species string")
    some = spark.createDataFrame([("u", "oak"), ("q", "ash")], "uid string, species string")
    assert [tuple(r) for r in analytics.curated_against_full(some, full).collect()] == [("oak", 1, 2), ("ash", 1, 0), ("elm", 0, 1)]
    assert analytics.species_counts(full, 1).count() == 2


def test_agreement_is_camera_minus_reference(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0), (3.0, 5.5)], "x double, y double")
    r = df.agg(*analytics.agreement("x", "y")).first()
    assert r.bias == pytest.approx(13 / 6) and r.n == 3 and r.slope == pytest.approx(1.25) and r.r2 == pytest.approx(np.corrcoef([1, 2, 3], [3, 4, 5.5])[0, 1] ** 2)


def test_profiles_take_the_first_column_there_is(spark):
    smoothed = spark.createDataFrame([("a", d, None if d == 3 else float(d)) for d in range(1, 6)] + [("b", 1, 1.0), ("c", 1, 1.0)], "uid string, doy int, p90 double")
    found = spark.createDataFrame([("a", 1.0), ("b", None), ("z", 1.0)], "uid string, up double")
    out = analytics.profiles(found, smoothed, ["uid"], ["none", "p90"], ["up"]).orderBy("doy").collect()
    assert [(r.uid, r.doy, r.scaled) for r in out] == [("a", 1, 0.0), ("a", 2, 0.25), ("a", 4, 0.75), ("a", 5, 1.0)]


def test_latex_table(spark):
    from canopyspark.plans.tables import latex

    stats = analytics.group_stats(spark.createDataFrame([("oak", "Low", 1.0), ("oak", "Low", 3.0), ("elm", "Mid", 5.0)], "species string, band string, gu double"), ["species", "band"], ["gu"])
    text = latex(stats, "species", "band", ["Low", "Mid"], [("GU", "{gu_mean:.1f}"), ("n", "{gu_n}")])
    assert "elm & -- & -- & 5.0 & 1 \\\\" in text and "oak & 2.0 & 2 & -- & -- \\\\" in text


def test_overlay():
    from canopyspark.functions import overlay

    square = lambda x, y: [[x, y], [x + 30, y], [x + 30, y + 30], [x, y + 30]]
    picture = overlay.draw(np.zeros((50, 130, 3), np.uint8), [("individual tree", square(5, 5)), ("grassland", square(90, 5)), ("lake", square(50, 15))])
    assert picture[5, 15].tolist() == [255, 52, 255] and picture[20, 20].tolist() == [127, 26, 127] and picture[9, 9].tolist() == [0, 0, 0]
    assert picture[5, 105].tolist() == [65, 137, 0] and not picture[:, 42:84].any()
    over = [overlay.draw(np.zeros((50, 130, 3), np.uint8), r)[5, 15].tolist() for r in ([("shrubs", square(5, 5)), ("other", square(5, 5))], [("other", square(5, 5)), ("shrubs", square(5, 5))])]
    assert over == [[0, 255, 114], [0, 255, 114]]
    assert overlay.png(picture)[1:4] == b"PNG"


@pytest.mark.parametrize("name", ["mask_sizes", "slanted_masks"])
def test_masks_are_dealt(spark, sf, name):
    """A small file of rings is no one task's work, and equal rings of a batch have equal masks, null ones none."""
    from canopyspark.plans import catalog

    assert catalog.QUERIES[name](spark, sf).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    rings = [[[5.9, 5.0], [25.0, 5.0], [25.0, 25.0]], None, [[0.0, 0.0], [3.0, 0.0], [3.0, 3.0]], [[5.9, 5.0], [25.0, 5.0], [25.0, 25.0]]]
    rows = spark.createDataFrame([(i, r, 40, w) for i, (r, w) in enumerate(zip(rings, (60, 60, 60, 20), strict=True))], "i int, ring array<array<double>>, h int, w int").coalesce(1)
    out = {r.i: r.m for r in rows.select("i", geometry.mask_pixels(F.col("ring"), F.col("h"), F.col("w")).alias("m")).collect()}
    assert out == {i: None if r is None else geometry.fill(r, 40, 20 if i == 3 else 60).tolist() for i, r in enumerate(rings)}


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Many folders aren't a task each; the setting is as before afterwards, and no file is lost."""
    from canopyspark.sources import files

    for i in range(100):
        folder = tmp_path / "a_1" / str(i) / "2020"
        folder.mkdir(parents=True)
        (folder / f"{i}_2020-done.json").write_text("{}")
    tasks = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalTasks()
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, setting = tasks(), spark.conf.get(name)
    done = files.completed(spark, str(tmp_path), "-done.json")
    assert tasks() - before <= files.LISTERS and spark.conf.get(name) == setting
    assert {r.uid for r in done.collect()} == {str(i) for i in range(100)}
