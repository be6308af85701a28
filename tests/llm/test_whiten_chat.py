"""Whitening against a plain eigendecomposition, chat formatting against the rows it came from; odd tables for both."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from canopyspark.llm import chat, whitening
from canopyspark.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"


def plain(vectors):
    """Fit list, covariance and deviations of rows (id, vector) with plain matrices."""
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in vectors}
    u = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, sums = len(u), u.sum(0)
    centred = np.array((u * n - sums).tolist(), float) / n
    return x, n, sums, centred.T @ centred / n


def held(rows, vectors, least=1e-9):
    """A whitened table against its definition."""
    x, n, sums, v = plain(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    found = {}
    for r in rows:
        assert (r.n, r.deviation) == (n, sum((n * a - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True)))
        assert r.identity_error <= 1e-4
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-6, abs=1e-12)
        found.setdefault(r.component, {})[r.vec_id] = r.whitened
    for c, got in found.items():
        want = {i: float((np.array(y, float) - np.array(sums, float) / n) @ axes[:, c - 1] / np.sqrt(max(values[c - 1], 1e-300))) for i, y in x.items()}
        if values[c - 1] < least:
            assert set(got.values()) == {None}
            continue
        top = max(want, key=lambda i: abs(want[i]))
        sign = np.sign(want[top] * got[top])
        assert all(got[i] * sign == pytest.approx(want[i], abs=1e-6) for i in got)
    return found


def all_of(spark, df, components=16):
    model = whitening.fit(df, components=components)
    rows = whitening.whiten(df, model).selectExpr("vec_id", "deviation", "posexplode(whitened) AS (place, whitened)")
    from pyspark.sql import functions as F

    return rows.selectExpr("vec_id", "place + 1 AS component", "cast(deviation AS long) AS deviation", "whitened").withColumns({
        "n": F.lit(model.n), "identity_error": F.lit(model.error), "explained": F.get(F.array(*map(F.lit, model.explained())), F.col("component") - 1)}).collect()


def test_whitening_query_is_recomputed(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = QUERIES["op11_whitening"](spark, sf).collect()
    assert len(rows) == 16 * len(vectors) and all(r.vec_id is not None for r in rows)
    assert set(held(rows, vectors)) == set(range(1, 17))


@pytest.mark.parametrize("partitions", [1, 23])
def test_whitening_over_a_tree_of_partitions(spark, partitions, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "STEP", 64)
    rng = np.random.default_rng(partitions)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate((rng.normal(size=(900, 5)) @ rng.normal(size=(5, 5)) * 3).astype(np.float32))]
    vectors += [(10_000 + i, vectors[0][1]) for i in range(400)]  # copies count once in the fit and all in the result
    df = spark.createDataFrame([(*v, 1) for v in vectors], VECTORS).repartition(partitions)
    rows = all_of(spark, df)
    assert len(rows) == 1300 * 5
    held(rows, vectors)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (2, [1.5, -2.0, 0.5]), (3, [0.25, 7.0, 0.5]), (None, [4.0, 4.0, 0.5])]
    rows = [(1, None), (2, []), (4, [1.0, None, 0.0]), (5, [1.0, nan, 0.0]), (6, [inf, 1.0, 0.0]), *good, (1, [1.0, 2.0, 0.5])]
    df = spark.createDataFrame([(*r, 7) for r in rows], VECTORS).selectExpr("*", "'mine' AS whitened", "'mine' AS Deviation", "'x' AS raw", "'y' AS part", "'z' AS `a.b`")
    model = whitening.fit(df)
    out = whitening.whiten(df, model)
    assert [c for c in out.columns] == ["vec_id", "embedding", "label", "raw", "part", "a.b", "whitened", "deviation"]
    got = out.collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 1, 2, 3] and {r["a.b"] for r in got} == {"z"}
    assert model.n == 4 and model.rank == 2  # an entry that is constant can't be whitened
    assert all(r.whitened[2] is None and r.whitened[1] is not None for r in got)


def test_whitening_of_few_rows(spark):
    df = spark.createDataFrame([], VECTORS)
    assert whitening.fit(df) is None
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)
    model = whitening.fit(one)
    assert (model.n, model.rank, model.error) == (1, 0, None)
    assert [list(r.whitened) for r in whitening.whiten(one, model).collect()] == [[None, None]] * 2
    mixed = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0], 0)], VECTORS)
    for parts in (1, 2):
        with pytest.raises(Exception, match="no common covariance"):
            whitening.fit(mixed.repartition(parts, "vec_id"))
    with pytest.raises(Exception, match="too large"):
        whitening.fit(spark.createDataFrame([(1, [3e38, 1.0], 0)], VECTORS))


@pytest.mark.parametrize("bits", [3, 28, 50, 60])
def test_deviations_are_exact(bits):
    gap = np.random.default_rng(bits).integers(-(1 << bits), 1 << bits, (50, 64))
    assert whitening.deviations(gap) == [sum(int(v) ** 2 for v in row) for row in gap]


def test_an_empty_embedding_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op11_whitening"](spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# Chat

ODD = [
    "", "x", " ", "\n", "\\", "</s>", "<\\/s>", "<\\\\/s>", "[INST] a [/INST]", "[\\INST]", "<<SYS>>", "<</SYS>", "<<<</SYS>>>>", "[[INST]]", "[TURN]\"a\"\nb[/TURN]", "<|endoftext|>", "<\\|endoftext|>", "[", "<", "[/", "a[/INST",
    "é É ß 漢字 \U0001f600 é", "don't  stop\t\n\n  now ", "   　", "\r\n", "0123456789 " * 3, "<s>", "</s", "s>",
]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", 'a "b"\n[/TURN]\\', "User"])
def test_rendering_is_reversible(role):
    turns = [(role, t) for t in ODD] + [("assistant", a + b) for a in ODD for b in ODD]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert all(chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS) for _, t in turns)


def test_masks_follow_the_texts(vocabulary):
    turns = [(r, a) for a in ODD for r in ("user", "assistant", "tool")]
    text, spans = chat.render(turns)
    (ids, starts, ends), = chat.encode([text], vocabulary)
    loss = chat.mask(starts, ends, spans)
    assert loss.tolist() == [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends, strict=True)]
    assert all(any(a <= s and e <= b for a, b in spans) for s, e, m in zip(starts, ends, loss, strict=True) if m)  # none reaches over a border
    assert chat.masked(text, starts, ends, loss) == "".join(t for r, t in turns if r == "assistant")
    assert chat.tokenizer(vocabulary).decode(ids.tolist(), skip_special_tokens=False) == text


def test_long_texts_are_cut_without_a_change(vocabulary, monkeypatch):
    texts = [" ".join(ODD) * 20, "word " * 500, "x" * 3000, " " * 900 + "end", "a  b   c\n d \x1c e \x85 f" * 99]
    whole = chat.encode(texts, vocabulary)
    monkeypatch.setattr(chat, "PIECE_CHARS", 50)
    assert len(chat.cuts(texts[1])) > 40
    for one, other in zip(whole, chat.encode(texts, vocabulary), strict=True):
        assert all((a == b).all() for a, b in zip(one, other, strict=True))


def rows_of(turns):
    """What read_back says, from rows (conv, turn, role, text) of distinct turns."""
    out = {}
    for c in {t[0] for t in turns}:
        own = [(r or "", t or "") for _, _, r, t in sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0))]
        learnt = "".join(t for r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_conversations_of_odd_rows(spark, vocabulary, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(chat, "LONG_TURNS", 20)
        monkeypatch.setattr(chat, "ROW_CHARS", 40)
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(ODD)] + [(2, 5, None, None), (2, None, "assistant", "first"), (2, 9, "assistant", "z" * 70_000)]
    turns += [(None, i, "assistant", f"t{i}") for i in range(60)] + [(3, 0, "tool", "only")] + [(c, 0, "user", "hot") for c in range(100, 160)]
    df = spark.createDataFrame(turns, TURNS).selectExpr("*", "'mine' AS conv", "1 AS tie", "2 AS segment", "3 AS `a.b`").repartition(5)
    made = chat.format_conversations(df, vocabulary)
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()}
    assert out == rows_of(turns)
    segments = made.groupBy("conv_id").count().collect()
    if hot:
        assert max(r["count"] for r in segments if r.conv_id == 1) > 3
    else:
        assert {r["count"] for r in segments if r.conv_id is not None} == {1}


def test_repeated_turns_stay(spark, vocabulary):
    df = spark.createDataFrame([(1, 0, "user", "a")] * 3 + [(1, 0, "assistant", "b")] * 2, TURNS)
    (r,) = chat.read_back(chat.format_conversations(df, vocabulary)).collect()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (5, 2, hashlib.sha256(b"bb").hexdigest())


def test_no_conversations(spark, vocabulary):
    df = spark.createDataFrame([], TURNS)
    assert chat.read_back(chat.format_conversations(df, vocabulary)).count() == 0
    with pytest.raises(TypeError):
        chat.format_conversations(spark.createDataFrame([("a", 1, "user", "x")], "conv_id string, turn long, role string, text string"), vocabulary)


def test_chat_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = QUERIES["op12_chat"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op12_chat']})").fetchall())


def test_escapes_in_sql_are_the_templates():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, 0, 'user', ?)", [(i, t) for i, t in enumerate(ODD)])
    got = dict(con.execute(f"SELECT conv_id, formatted_chars FROM ({chat.ORACLE})").fetchall())
    assert all(got[i] == len(chat.render([("user", t)])[0]) for i, t in enumerate(ODD))


def test_batches_without_rows_are_fine():
    sound, x = whitening.integers(pa.array([None, []], pa.list_(pa.float32())))
    assert sound.tolist() == [False, False] and x.shape == (0, 0)
