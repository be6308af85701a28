"""The corpus pipeline: each stage on its own input, against plain versions."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from canopyspark.llm import common


@pytest.fixture(scope="module")
def stages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = [common.stage(spark.read.parquet(f"{sf}/documents.parquet"), "docs")]
    for name, function in corpus_pipeline.STAGES:
        out.append(common.stage(function(spark, out[-1], sf), name))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "tokens"]
    assert all(df.columns == corpus_pipeline.COLUMNS for df in stages[:-1])


def test_quality_keeps_clean_documents(spark, sf, stages):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    kept = stages[1].select("doc_id").withColumn("kept", F.lit(True))
    out = labels.join(kept, "doc_id", "left").select("quality", F.coalesce("kept", F.lit(False)).alias("kept")).toPandas()
    assert out[out.quality == 1].kept.mean() > 0.99 and out[out.quality == 0].kept.mean() < 0.05


def test_lines_and_near_duplicates(stages):
    from test_llm import brute_components, brute_lines

    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i: t for i, _, n, t in brute_lines(before, 10) if n == 0 or t.split()}
    after = {r.doc_id: r.text for r in stages[2].collect()}
    assert after == want
    parts = brute_components(list(after.items()))
    assert Counter(r.doc_id for r in stages[3].collect()) == Counter(i for i, (_, c) in parts.items() if i == c)


def test_mix_repeats_whole_documents(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    taken = Counter(r.doc_id for r in stages[4].collect())
    assert set(taken) <= set(before) and set(taken.values()) <= {1, 2}
    size = sum(len(t.split()) for t in before.values())
    assert sum(n * len(before[i].split()) for i, n in taken.items()) == pytest.approx(1.5 * size, rel=0.05)
    assert stages[5].count() == stages[4].count()


def test_tokens_are_the_librarys(stages):
    import hashlib

    from test_llm import library

    ref = library()
    texts = {r.doc_id: r.text or "" for r in stages[4].collect()}
    ids = {k: ref.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    rows = stages[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages[4].select("doc_id").collect())
    for r in rows:
        assert list(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(ref.decode(list(r.ids), skip_special_tokens=False).encode()).hexdigest()


def test_rows_without_an_id_pass_near_duplicates(spark, sf):
    rows = [(None, "one two three four five six", "en", "a", 1)] * 3 + [(2, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (1, "other words here", "en", "a", 1), (3, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate_stage(spark, df, sf)
    assert Counter(r.doc_id for r in out.collect()) == {None: 3, 1: 2, 3: 1}


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 0
