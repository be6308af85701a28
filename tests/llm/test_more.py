"""Queries of the llm folder recomputed by plain loops; results that don't depend on layouts; names that clash."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from test_llm import LONG, ROWS, SCHEMA, library, text_of

from canopyspark.llm import bpe, common, linededup, minhash, mixing, quality, sharding, suffixes, syncmers, tokenfile, topk
from canopyspark.llm.queries import QUERIES

NAMES = ["x.y", "_", "__", "_h", "_l", "_of", "_hits", "_cut", "_source", "_start", "_bucket", "_end", "_k", "_b", "_t", "_alone", "SIZE", "Taken", "_rest", "Score", "IDS", "spans", "doc", "_doc", "batch", "copy", "Next_Text", "N_lines"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("*", *[F.lit(f"my {n}").alias(n) for n in NAMES])


def documents(spark, sf):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


# Recomputed


def spark_hash(*values):
    """xxhash64 as Spark chains it over values, as an unsigned number."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<Q", v), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_syncmers(text):
    letters = regex.findall(syncmers.LETTER, text)
    h = [spark_hash(x) for x in letters]
    p = [spark_hash(a, b) for a, b in zip(h, h[1:], strict=False)]
    out = []
    for i in range(len(h) - 4):
        inner = p[i : i + 4]
        if min(map(signed, (inner[0], inner[3]))) <= min(map(signed, inner[1:3])):
            out.append(spark_hash(p[i], h[i + 2], p[i + 3]))
    return out or ([spark_hash(*h)] if h else [])


def plain_sketch(text):
    return sorted({x >> 32 for x in plain_syncmers(text)})[:64]


def plain_likeness(a, b):
    union = sorted(set(a) | set(b))[:64]
    return len([x for x in union if x in a and x in b]) / len(union) if union else 1.0


def test_fingerprint_query_is_recomputed(spark, sf):
    docs = documents(spark, sf)
    got = {r.doc_id: r for r in QUERIES["op2_syncmer_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    sketches = {i: plain_sketch(t) for i, t in docs}
    shown = lambda s: "".join(f"{x:08x}" for x in s)
    for (i, text), (j, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        sketch = plain_sketch(edited)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(sketches[i]), shown(sketch))
        assert r.near_edited == pytest.approx(plain_likeness(sketches[i], sketch)) and r.near_next == pytest.approx(plain_likeness(sketches[i], sketches[j]))


def test_quality_query_is_a_plain_loop(spark, sf):
    docs = dict(documents(spark, sf))
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    known = sorted((signed(spark_hash(i)), float(y), i) for i, y in labels if i in docs and zlib.crc32(str(i).encode()) % 4 != 2)
    assert 20 < len(known) <= quality.TRAINING_ROWS
    features = lambda t: {int(k): float(np.float32(v)) for k, v in zip(*quality.sparse(*quality.hashed_words(quality.pa.array([t]), False, quality.word_hash, quality.word_shape)[0]), strict=True)}
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for _, y, i in known:
            x = features(docs[i]) | {-1: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w[k]
                n[k] += g * g
    some = [weight(k) != 0 for k in z]
    assert 0 < sum(some) < len(some) / 2
    for r in QUERIES["op4_quality"](spark, sf).collect():
        score = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in (features(docs[r.doc_id]) | {-1: 1.0}).items())))
        assert r.score == pytest.approx(score, abs=1e-4) and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_token_file_query_matches_the_library(spark, sf):
    ref, start = library(), 0
    got = {r.doc_id: r for r in QUERIES["op9_token_files"](spark, sf).collect()}
    for i, text in documents(spark, sf):
        ids = [*ref.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_single_documents_of_token_files(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_BYTES", 100)
    tokenfile.write_tokens(odd, str(tmp_path / "t"), bpe.default_path())
    every = {(r.doc_id, r.start): r.ids for r in tokenfile.read_tokens(spark, str(tmp_path / "t")).collect()}
    some = tokenfile.read_tokens(spark, str(tmp_path / "t"), [4, 9, 77])
    assert {(r.doc_id, r.start): r.ids for r in some.collect()} == {k: v for k, v in every.items() if k[0] in (4, 9)}
    assert "lo" in some._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_shard_query_holds_its_law(spark, sf):
    docs = documents(spark, sf)
    rows = QUERIES["op8_shards"](spark, sf).collect()
    counts = Counter(r.shard for r in rows)
    assert sorted(r.doc_id for r in rows) == [i for i, _ in docs] and set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, k) for s in counts for k in range(counts[s])}
    sizes = {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs}
    assert all(r["size"] == (sizes[r.doc_id][0] if sizes[r.doc_id][0] > 8 else 8) and r.text_crc32 == sizes[r.doc_id][1] and r.law == "rows" and r.grown_shard is None for r in rows)


# Layouts and repeated rows


def test_shards_follow_from_the_rows(spark, odd):
    rows = odd.unionByName(odd).unionByName(odd.where("doc_id = 9")).select("doc_id", "text")
    many = rows.unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))
    many = many.unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")))
    found = [Counter(map(tuple, sharding.shuffle_into_shards(many.repartition(n), 5, bucket_bytes=400).collect())) for n in (2, 3, 7)]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == many.count()
    same = sorted(r[4] * 5 + r[3] for r in found[0].elements() if r[0] == 7 and r[1] == "same")
    assert len(same) == 500 and np.std(same) > 100  # copies scatter over the whole sequence


@pytest.mark.parametrize("copies", [1, 7, 1000])
def test_a_mix_takes_equal_rows_one_by_one(spark, copies):
    rows = [(1, "a", "w w w")] * copies + [(2, "b", " ".join("w" * 40))] * 10 + [(3, None, None), (3, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    out = mixing.mix_sources(df).toPandas()
    again = mixing.mix_sources(df.repartition(5)).toPandas()
    key = lambda d: Counter(zip(d.doc_id, d["size"], d.target.round(6), d.taken, strict=True))
    assert len(out) == len(rows) and key(out) == key(again) and (out.taken <= 2 * out["size"]).all()
    for source, size in (("1", 3), ("2", 40)):
        mine = out[out.doc_id == int(source)]
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= size / 2


def test_neighbours_of_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BLOCK_ROWS", 16)
    rows = [(None, f"n{i}") for i in range(100)] + [(5, f"t{i}") for i in range(150)] + [(i, f"x{i}") for i in range(50) if i != 5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, syncmers.with_next(df.repartition(n), "doc_id", ["text"]).collect()), key=str) for n in (2, 5)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    after = {t: n for _, t, n in found[0]}
    assert sorted(after.values()) == sorted(t for _, t in rows)  # one ring
    at, seen = "x0", []
    while at not in seen:
        seen.append(at)
        at = after[at]
    key = dict((t, -1 if k is None else k) for k, t in rows)
    ring = seen[[key[t] for t in seen].index(-1) :] + seen[: [key[t] for t in seen].index(-1)]
    assert len(seen) == len(rows) and [key[t] for t in ring] == sorted(key.values())


@pytest.mark.parametrize(("keys", "size"), [(100, 32 << 20), (1, 32 << 20), (2, 32 << 20), (100, 0), (100, 100), (2, 100)])
def test_hot_keys_meet_what_others_meet(spark, monkeypatch, keys, size):
    """Values of hot keys by broadcast, beyond the bytes by copies to parts, beyond the number of keys by key."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_KEYS", keys)
    monkeypatch.setattr(common, "HOT_BYTES", size)
    numbers = [1] * 40 + [2] * 3 + [None] * 20 + [3] * 12 + [4] + [5] * 30
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(numbers)], "k long, i long")
    right = common.stage(rows.where("k IS NOT NULL AND k <> 4").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("v")), "right")
    last = {k: max(i for i, x in enumerate(numbers) if x == k) for k in (1, 2, 3, 5)}
    out = common.join_hot(rows, right, ["k"], "n", F.lit(1)).collect()
    assert sorted((r.i, r.v) for r in out) == [(i, last.get(k)) for i, k in enumerate(numbers)]


def test_rows_of_a_long_value_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_BYTES", 0)
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("k"), "id")
    right = common.stage(spark.createDataFrame([(7, 4000, "long")], "k long, n long, v string"), "right")
    out = common.join_hot(rows, right, ["k"], "n", F.length("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(parts) == 4000 and max(parts) < 3000


def test_runs_are_not_shuffled_again(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = linededup.LineRuns(spark, min_docs=2, fanout=9)
        keys = spark.range(500).select(F.col("id").cast("string").cast("binary").alias("key"))
        runs.add(keys)
        runs.add(keys.unionByName(keys.limit(50)))
        merged = runs._merged(runs.levels[0])
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
        assert sorted(r.n for r in merged.collect()) == [2] * 450 + [3] * 50
        runs._merge([0], 1)
        batch = keys.groupBy("key").count().join(runs.done[0].select("key"), "key", "left_anti")
        plan = batch._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # that of the batch's own counts
        assert runs.settled().count() == 500
        names = list(runs.tables.values())
        runs.close()
        assert names and not any(spark.catalog.tableExists(n) for n in names)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_runs_settle(spark):
    runs = linededup.LineRuns(spark, min_docs=4, fanout=2)
    rng = np.random.default_rng(4)
    seen = Counter()
    for _ in range(11):
        batch = [bytes([int(k)]) for k in rng.zipf(1.3, 40) if k < 200]
        seen.update(batch)
        runs.add(spark.createDataFrame([(k,) for k in batch], "key binary"))
    assert {bytes(r.key) for r in runs.settled().collect()} == {k for k, n in seen.items() if n >= 4}
    assert len(runs.done) <= 3
    runs.close()


def test_near_duplicates_with_hot_groups(spark, monkeypatch):
    from canopyspark.llm import minhash as m

    for module in (common, m):
        monkeypatch.setattr(module, "HOT_ROWS", 4)
    from test_llm import brute_components

    rng = np.random.default_rng(33)
    base = [f"b{i}" for i in range(120)]
    docs = [(i, " ".join(base)) for i in range(10)]
    for i in range(10, 40):
        w = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 6))):
            w[j] = f"n{rng.integers(1 << 30)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, text_of(rng, 8)) for i in range(20)]
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(docs)
    both = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z"), (3, ""), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(both).collect()) == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 1), (3, 2, 1), (4, 0, 4)]


def test_repeats_with_longer_left_parts(spark):
    from test_llm import brute_repeats

    rng = np.random.default_rng(71)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 1 << 40, n)]
    docs = []
    for _ in range(15):
        core, before = fresh(60), fresh(10)
        docs += [(len(docs) + k, " ".join(fresh(30) + (before if k < 2 else fresh(10)) + core + fresh(30))) for k in range(12)]
    out = suffixes.merged(suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))).collect()
    got, want = {r.doc: {j for s in r.spans for j in range(s.start, s.stop)} for r in out}, brute_repeats(docs)
    assert set(got) == set(want) and all(got[k] <= want[k] for k in got)
    assert sum(map(len, got.values())) >= 0.99 * sum(map(len, want.values()))


def test_repeats_over_pieces_of_long_texts(spark, monkeypatch):
    """Passages over the ends of pieces, of other lengths than they, in texts of one piece and of many."""
    from test_llm import brute_repeats

    monkeypatch.setattr(suffixes, "PIECE", 70)
    monkeypatch.setattr(suffixes, "MARGIN", 50)
    rng = np.random.default_rng(72)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 1 << 40, n)]
    passages = [fresh(n) for n in (49, 50, 69, 71, 150, 700)]
    docs = [(0, " ".join(fresh(2000) + passages[5] + fresh(5))), (1, " ".join(passages[5])), (2, "oak " * 400), (3, "oak " * 900), (4, None), (5, "")]
    for i in range(10, 50):
        w = fresh(int(rng.integers(0, 200)))
        for _ in range(int(rng.integers(0, 3))):
            w += passages[int(rng.integers(5))] + fresh(int(rng.integers(0, 100)))
        docs.append((i, " ".join(w)))
    docs += [(60 + i, docs[0][1]) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = {r.doc: {j for s in r.spans for j in range(s.start, s.stop)} for r in suffixes.merged(suffixes.repeated_passages(df)).collect()}
    assert out == brute_repeats([(k, t) for k, t in docs if t])


def test_a_match_goes_on_where_only_its_first_anchor_is_known(spark, monkeypatch):
    """Rounds of longer pieces follow a match to its ends, and a text is sent in the pieces that are needed alone."""
    rng = np.random.default_rng(73)
    words = [f"u{x}" for x in rng.integers(0, 1 << 40, 3000)]
    docs = spark.createDataFrame([(1, " ".join(["a"] * 7 + words)), (2, " ".join(words + ["b"])), (3, "c d")], "key long, text string")
    anchors = spark.createDataFrame([(1, 1507, 2, 1500)], "a long, pa long, b long, pb long")
    first = suffixes._extended(docs, anchors, 100, 50)
    (match,) = suffixes._whole(first.where("later IS NULL").drop("later").withColumnRenamed("doc", "a")).collect()
    assert (match.a, match.b, match.shift, match.start, match.stop, match.left, match.right) == (1, 2, -7, 1457, 1650, True, True)
    monkeypatch.setattr(suffixes, "PIECE", 100)
    monkeypatch.setattr(suffixes, "MARGIN", 50)
    monkeypatch.setattr(suffixes, "_neighbours", lambda array, order: anchors)
    out = suffixes.merged(suffixes.repeated_passages(docs, key="key")).collect()
    assert {r.doc: [tuple(s) for s in r.spans] for r in out} == {1: [(7, 3007)], 2: [(0, 3000)]}


# Clashing names


def kept_names(out, *replaced):
    assert all(n in out.columns for n in ["doc_id", *NAMES] if n.lower() not in replaced)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert len(rows) == len(ROWS) and {r["x.y"] for r in rows} == {"my x.y"} and {r["_hits"] for r in rows} == {"my _hits"} and {r["_cut"] for r in rows} == {"my _cut"}
    return rows


def test_no_name_clashes(spark, clashing):
    kept_names(sharding.shuffle_into_shards(clashing, 3), "size")
    kept_names(mixing.mix_sources(clashing), "size", "taken")
    kept_names(linededup.dedup_lines(clashing, min_docs=2), "n_lines")
    kept_names(bpe.encode_documents(clashing), "ids")
    kept_names(quality.score(clashing, quality.Weights(0.0, None)), "score")
    kept_names(syncmers.with_sketch(clashing, "text", "_y"))
    kept_names(syncmers.with_next(clashing.where("doc_id IS NOT NULL").unionByName(clashing.where("doc_id IS NULL")), "doc_id", ["text"]), "next_text")
    kept_names(suffixes.drop_repeated(clashing))
    assert minhash.near_duplicates(clashing).count() == len(ROWS) and suffixes.repeated_passages(clashing).count() > 0
    assert mixing.repeat_documents(mixing.mix_sources(clashing)).where("copy IS NULL").count() == 0


def test_keys_must_be_integers(spark, tmp_path):
    words = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    for run in (minhash.near_duplicates, suffixes.repeated_passages, lambda d: tokenfile.write_tokens(d, str(tmp_path / "out"), bpe.default_path())):
        with pytest.raises(TypeError, match="integers"):
            run(words)
    assert not list(tmp_path.iterdir())  # nothing was written
    with pytest.raises(TypeError, match="integers"):
        topk.search(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"), F.lit(True))


# Pipeline


def test_stages_take_odd_and_empty_tables(spark, sf, clashing):
    for table in (clashing, clashing.limit(0)):
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, table, sf)
            assert out.columns == (corpus_pipeline.COLUMNS if name != "tokens" else ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
            if table is not clashing:
                assert out.count() == 0, name
            elif name == "lines":
                assert out.count() == len(ROWS)
            elif name == "near_duplicates":
                assert Counter(r.doc_id for r in out.collect()) == Counter([1, 2, 3, 4, 4, 6, 8, 9, None])
            elif name == "tokens":
                assert [r.n_tokens for r in out.orderBy("doc_id").collect()][1:4] == [0, 0, 0]


def test_a_hot_group_goes_through_the_stages(spark, sf):
    rows = [(i, "one copy of many " * 20 if i % 3 == 0 else "" if i % 3 == 1 else f"its own text number {i} " * 5 + LONG[:400], "en", "hot" if i % 3 == 0 else "b", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    assert left.where("doc_id % 3 = 0").count() == 1 and left.where("doc_id % 3 = 1").count() == 100
    gone = corpus_pipeline.line_stage(spark, docs, sf)
    assert gone.where("doc_id % 3 = 0").count() == 0 and gone.where("doc_id % 3 = 1").count() == 100
    mixed = corpus_pipeline.mix_stage(spark, docs, sf)
    words = sum(len(t.split()) for _, t, *_ in rows)
    assert sum(len(r.text.split()) for r in mixed.collect()) == pytest.approx(1.5 * words, rel=0.05)
