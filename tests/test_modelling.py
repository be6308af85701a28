"""The third stage over files: what is read, made and kept once."""

import pytest

from canopyspark.plans import config, file_queries, stages
from canopyspark.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def root(tmp_path):
    """Three series with a season and, of another index, two that are too short."""
    for uid, top in (("a", 60), ("b", 45), ("c", 30)):
        folder = tmp_path / f"1_1/{uid}/2022"
        folder.mkdir(parents=True)
        lines = [f"2022-{m:02d}-{d:02d},{10 + top * max(0, 1 - abs(m - 7) / 4) + (d * m) % 5}" for m in range(1, 13) for d in (1, 7, 13, 19, 25)]
        (folder / f"{uid}_2022-GCC-3D-product.csv").write_text("\n".join(["date,p90", *lines]) + "\n")
        if uid != "c":
            (folder / f"{uid}_2022-RCC-3D-product.csv").write_text("\n".join(["date,p90", *lines[:3]]) + "\n")
    return tmp_path


def run(spark, root, **given):
    cfg = config.Modelling(root, root, random_seed=3, series_index=["GCC", "RCC"], mc_iterations=5)
    return {(r.uid, r.series[:3]): r.status for r in stages.run_modelling(spark, cfg, **given).collect()}


SHORT = {("a", "RCC"): "too-short", ("b", "RCC"): "too-short"}


def test_what_is_done_is_not_estimated_again(spark, root, monkeypatch):
    """a run over done units went through the whole estimate of none."""
    seen, whole = [], stages.estimate
    monkeypatch.setattr(stages, "estimate", lambda product, cfg, *a, **k: seen.append((cfg.series_index, product)) or whole(product, cfg, *a, **k))
    assert run(spark, root) == {(u, "GCC"): "done" for u in "abc"} | SHORT
    assert [i for i, _ in seen] == ["GCC", "RCC"]
    assert run(spark, root) == {(u, "GCC"): "skip" for u in "abc"} | SHORT
    assert [i for i, _ in seen] == ["GCC", "RCC", "RCC"]
    assert not any("FileScan text" in plan(p) for _, p in seen)  # read and parsed once, whatever is made of it
    written = root / "1_1/b/2022/b_2022-GCC-3D-p90-transitions.json"
    before = written.read_text()
    written.unlink()
    assert run(spark, root) == {("a", "GCC"): "skip", ("b", "GCC"): "done", ("c", "GCC"): "skip"} | SHORT
    assert written.read_text() == before  # its noise is that of its place among all series
    assert run(spark, root, force=True) == {(u, "GCC"): "done" for u in "abc"} | SHORT


def test_series_are_smoothed_once(spark, root):
    """every part of the estimate smoothed the series anew."""
    product = files.read_product(spark, str(root), "GCC", "3D")
    out = stages.estimate(product, config.Modelling(root, root, random_seed=3, mc_iterations=2))
    assert "FileScan text" not in plan(out)
    assert {r.uid: (r.status, r.window_selected is None) for r in out.collect()} == {u: ("done", False) for u in "abc"}
    short = stages.estimate(files.read_product(spark, str(root), "RCC", "3D"), config.Modelling(root, root, random_seed=3, series_index="RCC"))
    assert {r.uid: r.status for r in short.collect()} == {"a": "too-short", "b": "too-short"}


def test_the_query_makes_its_bins_once(spark, sf, monkeypatch):
    """lines were joined and sorted once an index."""

    class Seen(Exception):
        pass

    def stop(product, strategies, root):
        raise Seen(plan(product), product.groupBy("channel", "uid", "year").count().collect())

    monkeypatch.setattr(stages, "write_products", stop)
    with pytest.raises(Seen) as found:
        file_queries.transition_files(spark, sf)
    text, counts = found.value.args
    assert text.count("FileScan parquet") == 2  # lines and suppliers
    assert {r["count"] for r in counts if r.channel == "RCC"} == {3} and sum(r.channel == "RCC" for r in counts) == sum(r.channel == "GCC" for r in counts)
