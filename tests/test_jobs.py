"""The jobs over growing input, failures between their writes, odd rows, and their command lines."""

import json
import os
import re
import subprocess
import sys
from collections import defaultdict
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest

from canopyspark.operators import resample
from jobs import daily_products, queries, text_archive

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
CFG = daily_products.Settings(low=0.5, high=60.0, exclude=["error"], files_per_batch=2)


def at(day, hour=12):
    return datetime(2024, 1, day, hour)


def day_rows(rows, cfg=CFG):
    """What the products are, from all rows (event, ts, user, kind, value) of all files in order: the last of an event and day counts."""
    last = {}
    for e, ts, user, kind, value in rows:
        if ts is not None and value is not None and cfg.low <= value <= cfg.high and kind not in cfg.exclude:
            last[e, user, ts.date()] = value
    groups = defaultdict(list)
    for (_, user, day), value in last.items():
        groups[user, day].append(value)
    return {k: (len(v), *(round(x, 9) for x in (np.mean(v), *np.quantile(v, [0.5, 0.75, 0.9])))) for k, v in groups.items()}


def put(spark, folder, name, rows):
    """A file of observations; a new one keeps those that are there."""
    spark.createDataFrame([(*r, None) for r in rows], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def products(spark, source, out):
    rows = daily_products.read(spark, str(source), str(out), CFG).collect()
    assert len({(r.user_id, r.date) for r in rows}) == len(rows)
    return {(r.user_id, r.date): (r.n, *(round(x, 9) for x in (r.avg, r.p50, r.p75, r.p90))) for r in rows}


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


FIRST = [(1, at(1), 7, "view", 10.0), (2, at(1, 13), 7, "view", 20.0), (3, at(2), 7, "click", 30.0), (4, at(1), 8, "error", 10.0), (5, at(1), 8, None, 59.0), (6, at(2), 8, "view", 100.0), (7, None, 8, "view", 1.0), (8, at(5), None, "view", 2.0)]
SECOND = [(9, at(1, 23), 7, "view", 40.0), (3, at(2), 7, "click", 31.0), (10, at(9), 9, "view", None), (11, at(9), 9, "view", float("nan")), (12, at(9), 9, "view", 5.0)]


def test_only_new_files_are_taken(spark, tmp_path):
    run = lambda: daily_products.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), CFG)
    put(spark, tmp_path / "in", "a", FIRST)
    assert run() == {"read": len(FIRST), "batches": 1}
    assert products(spark, tmp_path / "in", tmp_path / "out") == day_rows(FIRST)
    before = files(tmp_path / "out")
    put(spark, tmp_path / "in", "b", SECOND)  # a late row, one that came before with another value, a new day
    assert run() == {"read": len(SECOND), "batches": 1}
    assert products(spark, tmp_path / "in", tmp_path / "out") == day_rows(FIRST + SECOND)
    after = files(tmp_path / "out")
    day5 = {p: t for p, t in before.items() if "products/date=2024-01-05" in p}
    assert day5 and day5.items() <= after.items()  # days without news stay as they are
    assert run() == {"read": 0, "batches": 0}
    assert files(tmp_path / "out") == after


@pytest.mark.parametrize("broken", ["daily_product", "_replace"])
def test_a_failed_batch_is_made_again(spark, tmp_path, monkeypatch, broken):
    run = lambda: daily_products.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), CFG)
    put(spark, tmp_path / "in", "a", FIRST)
    run()
    put(spark, tmp_path / "in", "b", SECOND)

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if broken == "daily_product":  # after the observations, before the products
            m.setattr(resample, "daily_product", fail)
        else:  # before anything is written
            m.setattr(daily_products, "_replace_days", fail)
        with pytest.raises(Exception, match="lost"):
            run()
    assert run()["read"] == len(SECOND)
    assert products(spark, tmp_path / "in", tmp_path / "out") == day_rows(FIRST + SECOND)


def test_many_files_in_bounded_batches(spark, tmp_path):
    rows = [(i, at(1 + i % 20, i % 24), i % 5, "view", 1.0 + i % 50) for i in range(600)]
    for k in range(6):
        put(spark, tmp_path / "in", str(k), rows[k::6])
    assert daily_products.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), CFG) == {"read": 600, "batches": 3}
    assert products(spark, tmp_path / "in", tmp_path / "out") == day_rows(rows)


def test_no_observation_counts(spark, tmp_path):
    put(spark, tmp_path / "in", "a", [(1, at(1), 7, "error", 10.0)])
    daily_products.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), CFG)
    assert products(spark, tmp_path / "in", tmp_path / "out") == {}


def test_settings_are_checked():
    with pytest.raises(TypeError):
        daily_products.Settings(colour=1)
    assert daily_products.settings().exclude == ["error"] and text_archive.settings().rules().max_thresholds["digits"] == 0.05


# The text archive

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, status string"
TEXTS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t", None, "b"), (4, "one two three", "en", "gone"), (5, "one two three four five", "en", None), (6, "same\nsame\nsame\nsame five six", "de", "a"),
    (7, "12345 6789 abc", "en", "a"), (8, "long " * 50_000, "fr", "a"), (9, "漢字 é Ω \U0001f600 " * 3, "en", "a"), (9, "漢字 é Ω \U0001f600 " * 3, "en", "a"), (None, "no id at all here", "en", "a"), (10, "null lang has words", None, "a"),
]
RULES = text_archive.Settings({"words": 3, "letters": 0.5, "own_lines": 0.6}, {"digits": 0.3, "line_words": 1000}, [], ["lang"], ["gone"])


def plain(text, lang):
    if text is None:
        m = {}
    else:
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
        m = {"words": len(words), "own_lines": len(set(lines)) / len(lines), "line_words": len(words) / len(lines)}
        if text:
            m |= {"letters": sum(c.isalpha() for c in text) / len(text), "digits": sum(c in "0123456789" for c in text) / len(text)}
    bad = [k for k, b in RULES.min_thresholds.items() if m.get(k) is None or m[k] < b] + [k for k, b in RULES.max_thresholds.items() if m.get(k) is None or m[k] > b]
    return m, bad + ([] if lang else ["lang"])


def archive(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "mine") for r in rows], DOCUMENTS).write.parquet(str(folder / "documents"))
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 0), (9, 0, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels"))
    return lambda: text_archive.run(spark, str(folder / "documents"), str(folder / "labels"), str(folder / "out"), RULES)


def test_archive_of_odd_texts(spark, tmp_path):
    run = archive(spark, tmp_path, TEXTS)
    counts = run()
    got = sorted(((r.doc_id or 0), r.source or "", r.status, tuple(r.failed), r.quality, *(None if r[m] is None else round(r[m], 9) for m in text_archive.METRICS)) for r in text_archive.read(spark, str(tmp_path / "out")).collect())
    want = []
    for i, text, lang, source in TEXTS:
        m, bad = plain(text, lang)
        names = [next(x for x in text_archive.records.rule_labels(RULES.rules()) if f" {k} " in x) for k in bad]
        status = "listed" if source == "gone" else "dropped" if bad else "accepted"
        want.append(((i or 0), source or "", status, tuple(names), {4: 1, 5: 1, 9: 0}.get(i), *(None if m.get(k) is None else round(m[k], 9) for k in text_archive.METRICS)))
    assert got == sorted(want)
    assert counts == {s: sum(w[2] == s for w in want) for s in ("accepted", "dropped", "listed")}
    report = {(r.lang, r.rule): r for r in spark.read.parquet(str(tmp_path / "out/report")).collect()}
    assert sum(r.documents for (_, rule), r in report.items() if rule == "req  lang present") == len(TEXTS)
    assert report[None, "req  lang present"].failed == 2
    en = report["en", "min  words >= 3"]
    accepted = [w[4] for w, t in zip(want, TEXTS, strict=True) if w[2] == "accepted" and t[2] == "en"]
    assert (en.failed, en.accepted, en.listed, en.labelled, en.good) == (sum("words" in plain(t, g)[1] for _, t, g, _ in TEXTS if g == "en"), len(accepted), 1, sum(q is not None for q in accepted), accepted.count(1))
    first = sorted(map(str, text_archive.read(spark, str(tmp_path / "out")).collect()))
    assert run() == counts and sorted(map(str, text_archive.read(spark, str(tmp_path / "out")).collect())) == first  # a run again writes the same rows
    assert {p.name for p in (tmp_path / "out/records").glob("status=*/language=*")} == {"language=en", "language=de", "language=fr", "language=unknown"}


def test_archive_of_nothing(spark, tmp_path):
    assert archive(spark, tmp_path, [])() == {}
    assert text_archive.read(spark, str(tmp_path / "out")).count() == 0 and spark.read.schema("lang string").parquet(str(tmp_path / "out/report")).count() == 0


# Command lines and queries


def test_command_lines(spark, tmp_path):
    put(spark, tmp_path / "in", "a", FIRST)
    archive(spark, tmp_path, TEXTS)
    (tmp_path / "rules.json").write_text(json.dumps({"min_thresholds": {"words": 4}}))
    top = str(Path(__file__).resolve().parents[1])
    calls = [
        ["jobs.daily_products", "--source", tmp_path / "in", "--out", tmp_path / "o1", "--checkpoint", tmp_path / "ck"],
        ["jobs.text_archive", "--documents", tmp_path / "documents", "--labels", tmp_path / "labels", "--out", tmp_path / "o2", "--config", tmp_path / "rules.json"],
    ]
    for call in calls:
        done = subprocess.run([sys.executable, "-m", *map(str, call)], cwd=top, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g pyspark-shell"}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert re.search(r"INFO:jobs\.\w+:.*(read 8 new rows|read 12 documents)", done.stderr)
    assert products(spark, tmp_path / "in", tmp_path / "o1") == day_rows(FIRST)
    assert text_archive.read(spark, str(tmp_path / "o2")).where("status = 'accepted'").count() == sum(plain(t, "x")[0].get("words", 0) >= 4 for _, t, _, _ in TEXTS)


def test_job_queries_leave_settings_as_they_are(spark, sf):
    before = dict(spark.conf.getAll)
    for query in queries.QUERIES.values():
        assert query(spark, sf).count() > 0
    assert dict(spark.conf.getAll) == before


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_queries_match_sql(spark, sf, name):
    import duckdb
    from test_entry import plain as rows_of

    con = duckdb.connect()
    for t in ("events", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert len(got) and rows_of(got) == rows_of(want)
