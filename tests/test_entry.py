"""The driver's contract: every query runs and says what its SQL says; the rest works without the llm folder."""

import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__
from canopyspark.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def plain(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, float):
            return f"{v:.5f}".replace("-0.00000", "0.00000")
        return f"{float(v):.5f}" if isinstance(v, int) and not isinstance(v, bool) else str(v).removesuffix(" 00:00:00")

    columns = sorted(df.columns)
    return sorted(tuple(text(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_llm_folder():
    hide = "import sys; sys.modules['canopyspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'three_day_product' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", hide], cwd=ROOT, check=True)


def test_only_the_entry_names_the_folder():
    for path in [*ROOT.glob("canopyspark/**/*.py")]:
        if "llm" not in path.parts:
            assert "canopyspark.llm" not in path.read_text() and "from ..llm" not in path.read_text(), path
