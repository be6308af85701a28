"""Near-duplicate documents: MinHash with banding, verification on full sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_BYTES, HOT_KEYS, HOT_ROWS, as_long, column, drop_staged, join_hot, map_batches, stage
from .components import components
from .words import hashed_words, once, runs, word_hash

#: Words a shingle, bands, rows a band. A pair at similarity 0.75 shares no band with probability 5e-6.
SHINGLE, BANDS, ROWS = 5, 32, 4
#: Two signatures must agree in this share of places before their sets are compared: 5 deviations below 0.75.
AGREE = 0.56
#: Shingles and sets in a chunk of members that are compared at once.
CHUNK_TOKENS, CHUNK_SETS = 8192, 256
_random = np.random.default_rng(20240601)
# Universal hashing of the high half of a shingle's hash: a * x + b with odd a, modulo 2^32.
_A = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles, A-Z in lower case; of all words as one if they are fewer."""
    return np.unique(runs(word_hash.array(text.encode().lower().split()), SHINGLE))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """:func:`shingles` of each text of a column."""
    return [np.unique(runs(h, SHINGLE)) for (h,) in hashed_words(texts, True, word_hash)]


def signature(s: np.ndarray, block: int = 2048) -> np.ndarray:
    """Minima of BANDS * ROWS universal hashes of a set that isn't empty."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), np.uint32((1 << 32) - 1))
    for i in range(0, len(x), block):
        np.minimum(out, (_A[:, None] * x[None, i : i + block] + _B[:, None]).min(axis=1), out=out)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < 75 * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked if the Jaccard similarity of their sets of 5-word shingles is 0.75 or more; component_id is
    the smallest key that links lead to. Texts without words (and null ones) are linked with nothing. Rows of one key
    are one node. A row whose key is null can't be named: it stands alone, component_id null, kept true.

    1. Rows with equal sets form a class, named by its smallest key; only classes go on, so copies cost a count.
    2. Each band of a class's signature is a bucket. The member of a bucket that lies in the most populous buckets is
       its centre; each other member is compared with it: first signatures, then full sets. Components of these links.
    3. In the buckets of one centre, members of different components are compared in full: those outside the largest
       component with all others, chunk by chunk; what comes out is one link for two components. So no link in a bucket is
       lost, no pair becomes a row, and groups that are one component by then cost nothing. Components of all links.

    Scale: buckets are counted with pre-aggregation and joined back on (band, hash), never gathered; what moves is
    32 short rows a class, and texts only of the classes in compared pairs. Where one set, bucket or centre has very many
    rows, these are met by broadcast and not dealt by it (see ``join_hot``), while a bound on the number of such keys holds.
    """

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, bands = [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            if len(s):
                ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                rows = signature(s).reshape(BANDS, ROWS).astype(np.uint64)
                bands.append(_signed(runs_of_rows(rows)))
            else:
                ids.append(None)
                bands.append(None)
        return pa.record_batch([batch.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "n", "set", "bands"])

    source = docs.select(as_long(docs, key).alias("key"), column(text).alias("text"))
    rows = stage(map_batches(source, sets, "key long, n long, set binary, bands array<long>"), "sets")
    named = rows.where(F.col("key").isNotNull() & F.col("set").isNotNull())
    names = stage(named.groupBy("set").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("rows")), "classes")
    # A class's bands come from the row that names it.
    lead = named.join(names, (F.col("key") == F.col("class")) & (named["set"] == names["set"]), "left_semi").dropDuplicates(["key", "set"])
    flat = lead.select(F.col("key").alias("class"), F.posexplode("bands").alias("band", "h"))
    flat = stage(flat, "bands")
    sizes = stage(flat.groupBy("band", "h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    member = stage(join_hot(flat, sizes, ["band", "h"], "m").where(F.col("m").isNotNull()), "members")
    drop_staged(flat)
    fame = member.groupBy("class").agg(F.sum("m").alias("fame"))
    famed = member.select("band", "h", "class", "m").join(fame, "class")
    best = famed.groupBy("band", "h").agg(F.max(F.struct("fame", (-F.col("class")).alias("less"))).alias("b"), F.max("m").alias("size"))
    best = stage(best.select("band", "h", "size", F.col("b.fame").alias("fame"), (-F.col("b.less")).alias("centre")), "centres")
    around = join_hot(member.select("band", "h", "class"), best, ["band", "h"], "size").where(F.col("class") != F.col("centre"))
    first = around.select(F.col("class").alias("a"), F.col("centre").alias("b"), "fame").distinct()
    texts = source.where(F.col("key").isNotNull())
    seen = stage(compared(stage(first, "pairs"), texts), "found")
    part = components(seen.where("link").select("a", "b"))
    found = stage(_further(seen, part), "found", batch_rows=16)
    if not found.isEmpty():
        # The first links are stars by now; only their stars and the new links are needed.
        part = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    # All rows of a class follow it; a key with several texts joins their components.
    several = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.coalesce("set", F.lit(b""))).alias("lo"), F.max(F.coalesce("set", F.lit(b""))).alias("hi")).where("lo <> hi").select("key")
    several = stage(several, "several")
    twice = not several.isEmpty()
    if twice:
        keyed = named.join(several, "key", "left_semi").select("key", "set").distinct().join(names, "set").select("key", "class")
        links = keyed.select(F.col("key").alias("a"), F.col("class").alias("b"))
        part = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
    of = stage(names.join(part, F.col("class") == F.col("node"), "left").select("set", "rows", F.coalesce("component", "class").alias("component_id")), "components")
    out = join_hot(rows.select("key", "n", "set"), of, ["set"], "rows")
    if twice:  # a row without words, whose key has words elsewhere
        blank = several.join(part, F.col("key") == F.col("node")).select("key", F.col("component").alias("_elsewhere"))
        out = out.join(blank, "key", "left").withColumn("component_id", F.coalesce("component_id", "_elsewhere"))
    out = out.withColumn("component_id", F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", (F.col("key").isNull() | (F.col("key") == F.col("component_id"))).alias("kept"))


def runs_of_rows(rows: np.ndarray) -> np.ndarray:
    """One hash of each band's rows."""
    out = np.full(len(rows), np.uint64(ROWS))
    for j in range(rows.shape[1]):
        out = runs(np.stack([out, rows[:, j]], 1).reshape(-1), 2)[::2]
    return out


def _further(seen: DataFrame, part: DataFrame) -> DataFrame:
    """Links (a, b) between different components among the members around one centre, one for two components and chunks.

    Members are dealt to chunks of about CHUNK_TOKENS shingles and CHUNK_SETS sets; chunks of members outside the largest
    component meet all chunks of the centre. Overlaps are a product of 0/1 matrices over the shingles that both chunks
    hold. Two members whose most famous centre is the same are compared around that centre only.
    """
    best = F.max(F.struct("fame", "b")).alias("top")
    top = seen.select("a", "b", "fame").groupBy("a").agg(best).select(F.col("a").alias("x"), F.col("top.b").alias("top"))
    around = seen.select(F.col("b").alias("c"), F.col("a").alias("x"), "s").join(part, F.col("x") == F.col("node"), "left").withColumn("of", F.coalesce("component", "x")).drop("node", "component").join(top, "x")
    sizes = around.groupBy("c", "of").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("s")).alias("t"))
    groups = sizes.groupBy("c").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "of")).alias("most"), F.sum("m").alias("m"), F.sum("t").alias("t")).where("parts > 1")
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK_SETS), F.ceil(F.col("t") / CHUNK_TOKENS))
    groups = stage(groups.select("c", "m", F.col("most.of").alias("largest"), chunks.alias("chunks")), "groups")
    open_ = join_hot(around, groups, ["c"], "m").where(F.col("chunks").isNotNull()).drop("m")
    open_ = stage(open_.withColumn("chunk", F.pmod(F.xxhash64("x"), F.col("chunks"))), "open")
    # A large group's chunks are dealt to several parts, eight to each, and meet all chunks there.
    parts = F.ceil(F.col("chunks") / 8)
    packed = lambda df, name: df.groupBy("c", "chunk", "chunks").agg(F.collect_list(F.struct("x", "of", "top", "s")).alias(name))
    ones = packed(open_.where(F.col("of") != F.col("largest")), "p").select("c", F.pmod("chunk", parts).alias("part"), "p")
    others = packed(open_, "q").select("c", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "q")
    met = ones.join(others, ["c", "part"])
    return map_batches(met.select("c", "p", "q"), _links, "a long, b long").distinct()


def _links(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = []
    for c, p, q in zip(batch.column("c").to_pylist(), batch.column("p"), batch.column("q"), strict=True):
        (x, of, top, sets), (x2, of2, top2, sets2) = _unpacked(p), _unpacked(q)
        common = np.intersect1d(np.concatenate(sets), np.concatenate(sets2))
        both = _incidence(sets, common) @ _incidence(sets2, common).T
        n, n2 = (np.array([len(s) for s in t]) for t in (sets, sets2))
        link = (7 * both >= 3 * (n[:, None] + n2[None, :])) & (of[:, None] != of2[None, :])
        link &= (top[:, None] != top2[None, :]) | (top[:, None] == c)
        i, j = np.nonzero(link)
        if len(i):
            _, one = np.unique(np.stack([of[i], of2[j]]), axis=1, return_index=True)
            found.append(np.stack([x[i[one]], x2[j[one]]]))
    a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def _unpacked(members: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    fields = members.values
    x, of, top = (fields.field(name).to_numpy() for name in ("x", "of", "top"))
    return x, of, top, [s.values.to_numpy() for s in fields.field("s")]


def _incidence(sets: list[np.ndarray], shingles_: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(shingles_)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(shingles_, s)
        at[at == len(shingles_)] = 0
        out[i, at[shingles_[at] == s] if len(shingles_) else []] = 1
    return out


def _joined(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with both texts. Those of centres with very many pairs come by broadcast, while their bytes are bounded."""
    one = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    centres = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    hot = stage(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= HOT_ROWS).select("b"), "hot")
    if not 0 < hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return one.join(centres, "b")
    famous = stage(centres.join(F.broadcast(hot), "b", "left_semi"), "famous")
    if (famous.agg(F.sum(F.octet_length("tb"))).first()[0] or 0) > HOT_BYTES:
        return one.join(centres, "b")
    by_key = one.join(F.broadcast(hot), "b", "left_anti").join(centres, "b")
    return by_key.unionByName(one.join(F.broadcast(famous), "b"))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """Sets and signatures of both texts of each row, made once for each distinct text."""
    texts, (left, right) = once(batch.column("ta"), batch.column("tb"))
    found = [(s, signature(s)) for s in shingle_sets(texts)]
    return ((found[i], found[j]) for i, j in zip(left, right, strict=True))


def linked(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    """Signatures first, then full sets."""
    return bool((x[1] == y[1]).mean() >= AGREE) and similar(x[0], y[0])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For each pair (a, centre b, ``fame``): whether it is a link, and the shingles ``s`` of a."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        link, sets = [], []
        for p, q in _sets(batch):
            link.append(linked(p, q))
            sets.append(_signed(p[0]))
        return pa.record_batch([*(batch.column(c) for c in ("a", "b", "fame")), pa.array(link, pa.bool_()), pa.array(sets, pa.list_(pa.int64()))], names=["a", "b", "fame", "link", "s"])

    return map_batches(_joined(pairs, texts).select("a", "b", "fame", "ta", "tb"), compare, "a long, b long, fame long, link boolean, s array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_minhash_dedup``: components of near-duplicate documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: DuckDB's own version of :func:`query`, over all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), f AS (
  SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), c AS (
  SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT c.node, p.b FROM c JOIN p ON c.reach = p.a
), m AS (SELECT node, min(reach) AS component_id FROM c GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON doc_id = node
"""
