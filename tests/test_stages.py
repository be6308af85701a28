"""All four stages from pictures on disk to records, settings and readers."""

import json
import struct
import zlib

import pandas as pd
import pytest

from canopyspark.plans import cli, config, stages
from canopyspark.sources import files


def png(path, bgr, height=40, width=60):
    row = b"\x00" + bytes(bgr[::-1]) * width
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(row * height)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for day in pd.date_range("2022-03-01", "2022-11-10", freq="4D"):
        green = 80 + int(60 * max(0, 1 - abs(day.dayofyear - 190) / 90))
        for hour in (9, 15):
            png(root / "images/1150/2/2022" / f"{day:%m}/{day:%d}/cam_{day:%Y-%m-%d}_{hour:02d}30.JPG".replace("JPG", "png"), (50, green, 100 + day.day % 3))
    png(root / "images/1150/2/2022/05/01/cam_2022-05-01_1000.png", (50, 100, 150), 20, 30)
    (root / "images/1150/2/2022/05/01/cam_2022-05-01_1100.png").write_bytes(b"no picture")
    square = [[5, 5], [25, 5], [25, 25], [5, 25]]
    rois = {"a1": {"name": "I.1", "coords": square, "category": "individual tree", "genus": "Fagus", "species": "Fagus sylvatica"}, "a2": {"name": "I.2", "coords": square, "category": "individual tree", "genus": "x", "species": "y"}, "a3": {"name": "Gp.3", "coords": square, "category": "group of trees", "genus": "x", "species": "y"}}
    (root / "polygons").mkdir()
    (root / "polygons/p.json").write_text(json.dumps(rois))
    (root / "annotations.json").write_text(json.dumps({"1150_2": {"2022": "p.json", "2021": "none.json"}}))
    (root / "uids.json").write_text(json.dumps({"a1": "i00001", "a3": "i00003"}))
    return root


def settings(root, name, **values):
    path = root / f"{name}.json"
    path.write_text(json.dumps(values))
    return path


@pytest.fixture(scope="module")
def dataset(spark, archive):
    out = archive / "dataset"
    one = settings(archive, "one", image_dataset_root=str(archive / "images"), output_root=str(out), polygon_files_root=str(archive / "polygons"), polygon_config_path=str(archive / "annotations.json"), uid_mapping_path=str(archive / "uids.json"))
    import canopyspark.functions.expressions as X

    kept, X.PICTURES = X.PICTURES, (*X.PICTURES, ".png")
    try:
        assert cli.main(["extract", "--config", str(one)]) == 0
    finally:
        X.PICTURES = kept
    two = settings(archive, "two", input_root=str(out), output_root=str(out), aggregation_strategies=["avg", "p50", "p75", "p90"])
    assert cli.main(["process", "--config", str(two)]) == 0
    three = settings(archive, "three", input_root=str(out), output_root=str(out), random_seed=3, mc_iterations=5, series_window=["1D", "3D"])
    assert cli.main(["transitions", "--config", str(three)]) == 0
    return out


def test_observations_and_metadata(spark, dataset):
    rows = pd.read_csv(dataset / "1150_2/i00001/2022/i00001_2022_raw-cc-data.csv")
    assert len(rows) == 2 * 64 and list(rows.columns)[:5] == ["datetime", "GCC", "RCC", "BCC", "brightness"]
    first = rows[rows.datetime == "2022-03-01_0930"].iloc[0]
    assert first.GCC == pytest.approx(80 / (50 + 80 + 101)) and first.brightness == 231 and first.GCC_s33 == pytest.approx(first.GCC)
    meta = json.loads((dataset / "1150_2/i00001/2022/i00001_2022_metadata.json").read_text())
    assert meta["area"] == 400 and meta["area_s33"] == pytest.approx(132) and meta["unique_id"] == "i00001" and meta["n_gaps"] == 63 and meta["max_obs_per_day"] == 2
    assert (dataset / "missing_uids.txt").read_text() == "1150_2/2022/a2\n" and (dataset / "extract.log").exists()
    assert not (dataset / "1150_2/i00003").exists()


def test_plot_mode(spark, dataset, archive):
    import canopyspark.functions.expressions as X

    kept, X.PICTURES = X.PICTURES, (*X.PICTURES, ".png")
    try:
        assert cli.main(["extract", "--config", str(archive / "one.json"), "--mode", "plot", "--plot-dir", str(archive / "plots")]) == 0
    finally:
        X.PICTURES = kept
    assert [p.name for p in (archive / "plots").iterdir()] == ["1150_2-2022.png"]


def test_products_and_flags(spark, dataset):
    folder = dataset / "1150_2/i00001/2022"
    assert len(list(folder.glob("*-product.csv"))) == 6 and len(list(folder.glob("*-smoothed.csv"))) == 6
    daily = pd.read_csv(folder / "i00001_2022-GCC-1D-product.csv")
    assert len(daily) == 253 and daily.avg.notna().sum() == 64
    flags = json.loads((folder / "i00001_2022-sampling-flags.json").read_text())
    assert flags["resolution_change_detected"] is False and flags["column_selected"]["GCC"] == "GCC_s33" and flags["gap_lengths_day"] == [4] * 63


def test_transitions_and_records(spark, dataset, archive):
    found = json.loads((dataset / "1150_2/i00001/2022/i00001_2022-GCC-3D-p90-transitions.json").read_text())
    assert 150 < found["dates"]["PEAK"] < 220 and found["dates"]["GU_50"] < found["dates"]["GD_50"] and found["uncertainties"]["GU_50_std"] >= 0 and found["window_selected"] in (3, 5, 7, 9)
    assert isinstance(found["snr"], float)
    four = settings(archive, "four", input_root=str(dataset), output_path=str(archive / "records.csv"), min_thresholds={"snr": -100}, required_keys=["GCC_3D_p90-GU_50"])
    assert cli.main(["aggregate", "--config", str(four), "--verbose"]) == 0
    assert "i00001_2022: accepted\n" in (archive / "aggregate.log").read_text()
    table = pd.read_csv(archive / "records.csv")
    first = ["location", "sublocation", "year", "full_name", "annotation_id", "name", "category", "genus", "species", "area", "area_s33", "start_date", "end_date"]
    assert list(table.columns)[:13] == first and table.columns[-1] == "GCC_3D_p90-season_length" and table.columns.is_unique
    row = pd.read_csv(archive / "records.csv", dtype=str).iloc[0]
    assert (row.location, row.sublocation, row.year, row.full_name, row.start_date, row.end_date) == ("1150", "2", "2022", "i00001_2022", "2022-03-01", "2022-11-08")
    assert (row.shrink_suffix, row.resolution_change_detected, row.noon_only_gate_config, row.n_gaps) == ("33", "False", "True", "63")
    assert json.loads(row.column_selected) == {"GCC": "GCC_s33", "RCC": "RCC_s33", "BCC": "BCC_s33"} and pd.isna(row.resolution_change_doy)
    assert len(table) == 1 and table["GCC_3D_p90-GU_50"][0] == pytest.approx(found["dates"]["GU_50"]) and table.species[0] == "Fagus sylvatica"
    assert table["GCC_3D_p90-season_length"][0] == pytest.approx(found["dates"]["GD_25"] - found["dates"]["GU_50"])
    assert "Total tree-years found : 1" in (archive / "records-filtering-report.txt").read_text()
    excluded = archive / "excluded.csv"
    excluded.write_text("uid,year,why\ni00001,2022,x\n")
    cli.main(["aggregate", "--config", str(four), "--exclude-csv", str(excluded), "--verbose"])
    assert "i00001_2022: excluded by list" in (archive / "aggregate.log").read_text()
    assert "Excluded (external CSV):   1 (100.0 %)" in (archive / "records-filtering-report.txt").read_text()


def test_done_units_are_skipped(spark, dataset, archive):
    two = config.Processing.load(archive / "two.json")
    assert [r.status for r in stages.run_processing(spark, two).collect()] == ["skip"]
    three = config.Modelling.load(archive / "three.json")
    assert {r.status for r in stages.run_modelling(spark, three).collect()} == {"skip"}
    assert files.read_product(spark, str(dataset), "GCC", "3D", "smoothed").count() == files.read_product(spark, str(dataset), "GCC", "3D").count()


def test_units_without_light_or_channels(spark, dataset):
    rows = files.read_observations(spark, str(dataset))
    base = {"input_root": dataset, "output_root": dataset}
    status = lambda cfg: [r.status for r in stages.process(rows, cfg)["status"].collect()]
    assert status(config.Processing(**base, brightness_min=600)) == ["empty-after-brightness"]
    assert status(config.Processing(**base, shrink_suffix="50")) == ["no-brightness-col"]
    assert status(config.Processing(**base, exclude_locations=["1150"])) == []


def test_fields_are_found_by_the_header_of_each_file(spark, tmp_path):
    def put(uid, name, text):
        path = tmp_path / f"1_2/{uid}/2022/{uid}_2022{name}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    put("a", "_raw-cc-data.csv", "datetime,GCC_s33,RCC_s33,BCC_s33,brightness_s33,GCC_s50,RCC_s50,BCC_s50,brightness_s50\n2022-05-01_1200,33,1,2,331,50,3,4,500\n")
    put("b", "_raw-cc-data.csv", "datetime,brightness_s50,GCC_s50\r\n2022-05-01_1200,400,nan\r\n2022-05-01_1300,401,7.5\r\n")
    put("c", "_raw-cc-data.csv", "datetime,GCC,brightness\n2022-05-01_1200,1,300\n")
    put("d", "_raw-cc-data.csv", "datetime,brightness_s50\n2022-05-01_1200,300\n")
    put("e", "_raw-cc-data.csv", "datetime,brightness_s50,GCC_s50\n")
    rows = files.read_observations(spark, str(tmp_path), (None, "50"))
    assert {(r.uid, r.GCC, r.GCC_s50, r.RCC_s50, r.brightness_s50) for r in rows.collect()} == {("a", None, 50, 3, 500), ("b", None, None, None, 400), ("b", None, 7.5, None, 401), ("c", 1, None, None, None), ("d", None, None, None, 300), ("e", None, None, None, None)}
    out = stages.process(rows, config.Processing(input_root=tmp_path, output_root=tmp_path, shrink_suffix="50", aggregation_windows=["3D"]))
    assert {r.uid: r.status for r in out["status"].collect()} == {"a": "done", "b": "done", "c": "no-brightness-col", "d": "no-matching-channels", "e": "empty-after-brightness"}
    assert {r.uid: r.column_selected for r in out["flags"].collect()} == {"a": {"GCC": "GCC_s50", "RCC": "RCC_s50", "BCC": "BCC_s50"}, "b": {"GCC": "GCC_s50"}}
    assert {(r.uid, r.channel, r.value) for r in out["product"].where("strategy = 'avg'").collect()} == {("a", "GCC", 50), ("a", "RCC", 3), ("a", "BCC", 4), ("b", "GCC", 7.5)}
    put("a", "-GCC-3D-product.csv", "date,p90,avg\n2022-05-01,0.9,0.1\n")
    put("b", "-GCC-3D-product.csv", "date,p90\n2022-05-01,0.8\n2022-05-04,\n")
    product = files.read_product(spark, str(tmp_path), "GCC", "3D")
    assert {(r.uid, r.doy, r.avg, r.p50, r.p90) for r in product.collect()} == {("a", 121, 0.1, None, 0.9), ("b", 121, None, None, 0.8), ("b", 124, None, None, None)}
    statuses = stages.estimate(product, config.Modelling(input_root=tmp_path, output_root=tmp_path, random_seed=1, series_strategy="avg", mc_iterations=2))
    assert {r.uid: r.status for r in statuses.collect()} == {"a": "too-short", "b": "missing-strategy"}
    put("a", "-GCC-3D-smoothed.csv", "date,avg,GCC-3D-p90_model\n2022-05-01,5,0.25\n2022-05-04,5,\n")
    put("b", "-GCC-3D-smoothed.csv", "date,p90\n2022-05-01,0.75\n")
    put("c", "-GCC-3D-smoothed.csv", "date,avg\n2022-05-01,0.75\n")
    assert {(r.uid, r.doy, r.value) for r in files.read_profiles(spark, str(tmp_path)).collect()} == {("a", 121, 0.25), ("b", 121, 0.75)}


def test_a_record_keeps_what_its_flags_are(spark, tmp_path):
    folder = tmp_path / "d/1_2/a/2022"
    folder.mkdir(parents=True)
    (folder / "a_2022_metadata.json").write_text(json.dumps({"full_name": "a_2022", "name": "I.1", "area": 4, "species": 'x "y", z'}))
    (folder / "a_2022-sampling-flags.json").write_text('{"start_date": "2022-01-02", "quoted": "5", "plain": 5, "share": NaN, "yes": true, "gap_lengths_day": [1], "column_selected": {"GCC": "GCC_s33"}, "resolution_change_doy": 201, "noon_only_applied": null}')
    (folder / "a_2022-GCC-3D-p90-transitions.json").write_text('{"dates": {"PEAK": 180, "GU_50": 100.5, "GD_25": 280, "GU_10": null}, "uncertainties": {"GU_50_std": 1.5, "PEAK_std": NaN}, "snr": Infinity, "n_peak": 1, "baseline": "9"}')
    base = {"input_root": tmp_path / "d", "output_path": tmp_path / "out/r.csv"}
    wide, _ = stages.run_aggregation(spark, config.Aggregation(**base))
    text = (tmp_path / "out/r.csv").read_text().splitlines()
    row = pd.read_csv(tmp_path / "out/r.csv", dtype=str, keep_default_na=False).iloc[0].to_dict()
    assert text[0] == "location,sublocation,year,full_name,annotation_id,name,category,genus,species,area,area_s33,start_date,resolution_change_detected,noon_only_applied,resolution_change_doy,noon_only_gate_config,column_selected,plain,quoted,share,yes,GCC_3D_p90-PEAK,GCC_3D_p90-GU_10,GCC_3D_p90-GD_25,GCC_3D_p90-GU_50,GCC_3D_p90-PEAK-std,GCC_3D_p90-GU_50-std,GCC_3D_p90-baseline,GCC_3D_p90-snr,GCC_3D_p90-n_peak,GCC_3D_p90-season_length"
    assert list(row.values()) == ["1", "2", "2022", "a_2022", "", "I.1", "", "", 'x "y", z', "4", "", "2022-01-02", "False", "", "201", "False", '{"GCC":"GCC_s33"}', "5", "5", "", "True", "180.0", "", "280.0", "100.5", "", "1.5", "", "Infinity", "1.0", "179.5"]
    passes = lambda **rule: stages.run_aggregation(spark, config.Aggregation(**base, **rule))[0].count()
    assert [passes(min_thresholds={k: 1}) for k in ("plain", "yes", "share", "quoted", "start_date")] == [1, 1, 1, 0, 0]


def test_shapes_from_the_first_bytes(spark, tmp_path):
    png(tmp_path / "a.png", (1, 2, 3), 20, 30)
    assert files.shape_of((tmp_path / "a.png").read_bytes()[:100]) == (20, 30)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"x" * 14 + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, 480, 640) + b"y" * 20
    assert files.shape_of(jpeg) == (480, 640) and files.shape_of(jpeg[:20]) is None and files.shape_of(b"no picture") is None and files.shape_of(b"") is None
    (tmp_path / "b.png").write_bytes(b"x")
    (tmp_path / "c.jpg").write_bytes(jpeg)
    paths = spark.createDataFrame([(f"file:{tmp_path}/{x}",) for x in ("a.png", "b.png", "c.jpg", "none.jpg")], "path string")
    assert {(r.path[-5:], r.height, r.width) for r in files.with_shapes(paths).collect()} == {("a.png", 20, 30), ("c.jpg", 480, 640)}


def test_only_folders_with_work_are_opened(spark, archive, monkeypatch):
    import canopyspark.functions.expressions as X

    monkeypatch.setattr(X, "PICTURES", (*X.PICTURES, ".png"))
    png(archive / "images/1151/2/2022/05/01/cam_2022-05-01_1000.png", (1, 2, 3))
    listed = files.list_pictures(spark, str(archive / "images"))
    assert listed.count() == 128 + 3 and "content" not in listed._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    some = files.read_pictures(spark, str(archive / "images"), ["1151/2/2022"])
    assert [r.location for r in some.select("location").collect()] == ["1151"]
    sizes = some._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles")
    some._jdf.queryExecution().toRdd().count()
    assert sizes.value() == 1


def test_snow_and_exclusion_readers(spark, tmp_path):
    (tmp_path / "1150").mkdir()
    (tmp_path / "1150/1150-2022-daily_snow_flag.csv").write_text("date,snow\n2022-01-01,1\n2022-01-02,0\n")
    assert sorted((r.location, r.date.day, r.snow) for r in files.read_snow(spark, str(tmp_path)).collect()) == [("1150", 1, 1), ("1150", 2, 0)]


@pytest.mark.parametrize(("name", "values"), [("process", {"brightness_min": 700}), ("process", {"aggregation_strategies": ["p99"]}), ("process", {"num_workers": 0}), ("transitions", {"cv_window_min": 4}), ("transitions", {"amplitude_thresholds": [1.0]}), ("transitions", {"series_index": "XCC"}), ("transitions", {"doy_min": 300, "doy_max": 200}), ("transitions", {"mc_iterations": 0}), ("aggregate", {"min_thresholds": []}), ("aggregate", {"input_root": "/nowhere"})])
def test_wrong_settings(tmp_path, name, values):
    base = {"process": {"output_root": "o"}, "transitions": {"output_root": "o", "random_seed": 1}, "aggregate": {"output_path": "o.csv"}}[name]
    path = settings(tmp_path, "s", **({"input_root": str(tmp_path)} | base | values))
    with pytest.raises(ValueError, match=":"):
        config.LOADERS[name](path)


def test_settings_defaults_and_combinations(tmp_path, caplog):
    path = settings(tmp_path, "s", input_root=str(tmp_path), output_root="o", random_seed=1, series_index=["GCC", "RCC"], series_window=["1D", "3D"], extra=1)
    loaded = config.Modelling.load(path)
    assert "extra" in caplog.text and [(c.series_index, c.series_window, c.candidates()[-1]) for c in loaded.combinations()] == [("GCC", "1D", 21), ("GCC", "3D", 9), ("RCC", "1D", 21), ("RCC", "3D", 9)]
    with pytest.raises(ValueError, match="can't be read"):
        config.Modelling.load(tmp_path / "none.json")
