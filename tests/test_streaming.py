"""Pictures and observations as streams; polygons of renamed sites."""

import json
from datetime import datetime

import pytest
from test_stages import png

from canopyspark.functions import expressions as X
from canopyspark.plans import stages
from canopyspark.sources import files
from canopyspark.streaming import incremental

SQUARE = [[5.0, 5.0], [25.0, 5.0], [25.0, 25.0], [5.0, 25.0]]


@pytest.fixture
def rings(spark):
    rows = [("1150", "2", "2022", "a1", "I.1", SQUARE, "individual tree")]
    polygons = spark.createDataFrame(rows, "location string, sublocation string, year string, annotation_id string, name string, coords array<array<double>>, category string")
    return stages.regions(polygons, ["individual tree"], [33])


def test_new_pictures_are_appended(spark, rings, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PICTURES", (*X.PICTURES, ".png"))
    run = lambda: incremental.extract_stream(spark, str(tmp_path / "images"), rings, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    folder = tmp_path / "images/1150/2/2022/05/01"
    png(folder / "cam_2022-05-01_1000.png", (50, 100, 150))
    run()
    png(folder / "cam_2022-05-01_1200.png", (10, 20, 30))
    run()
    out = sorted((r.ts, r.ring, round(r.gcc, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [(datetime(2022, 5, 1, h), ring, round(1 / 3, 6)) for h in (10, 12) for ring in ("", "_s33")]


def test_daily_means_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2022, 5, d, h), float(h)) for d in (1, 2, 9) for h in (6, 12)], "uid string, ts timestamp, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = incremental.daily_stream(stream, ["uid"]).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    query.processAllAvailable()
    out = {str(r.date): (r.avg, r.n) for r in spark.table("daily").collect()}
    query.stop()
    assert out == {"2022-05-01": (9.0, 2), "2022-05-02": (9.0, 2), "2022-05-09": (9.0, 2)}


def test_polygons_of_renamed_and_missing_sites(spark, tmp_path):
    roi = {"name": "I.1", "coords": SQUARE, "category": "individual tree", "genus": "g", "species": "s"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p/one.json").write_text(json.dumps({"a": roi, "b": roi}, indent=1))  # over several lines, as people write it
    (tmp_path / "c.json").write_text(json.dumps({"hill_cam": {"2020": "one.json"}, "1150": {"2021": "one.json", "2022": "gone.json"}}, indent=2))
    (tmp_path / "u.json").write_text(json.dumps({"a": "i1", "b": "i2"}, indent=2))
    assert {(r.annotation_id, r.uid) for r in files.read_uids(spark, str(tmp_path / "u.json")).collect()} == {("a", "i1"), ("b", "i2")}
    out = files.read_polygons(spark, str(tmp_path / "c.json"), str(tmp_path / "p"), {"hill_cam": "9f3", "1150": "zzz"}).collect()
    assert sorted((r.location, r.sublocation, r.year, r.annotation_id) for r in out) == [("1150", None, "2021", "a"), ("1150", None, "2021", "b"), ("9f3", "1", "2020", "a"), ("9f3", "1", "2020", "b")]
    assert out[0].coords == SQUARE and out[0].mix is None
