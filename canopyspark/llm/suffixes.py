"""Passages that repeat across documents: a sparse suffix array over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_long, bounded, column, free_stem, map_batches, quoted, schema_text, stage, word_count
from .words import by_text, coded_words, hashed_words, once, scatter, word_hash

#: A passage has at least MIN_WORDS words. Minimisers are taken of GRAM-word hashes in windows of WINDOW positions.
MIN_WORDS, GRAM, WINDOW = 50, 8, 32
#: Words right of the first minimiser of any passage: what suffixes must share to be compared.
SHARED = MIN_WORDS - WINDOW + 1
STEP = 8
#: Words of a piece of a text, and words that it has in common with the pieces beside it on either side (at least MIN_WORDS);
#: each round that goes on has pieces so many times longer.
PIECE, MARGIN, LONGER = 8192, 1024, 4
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Rolling:
    """Hashes of any run of words of a text in constant time."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.full(n + 1, _BASE)
        power[0] = 1
        back = np.full(n + 1, _INVERSE)
        back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power, dtype=np.uint64)[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return scatter((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of each text's words, A-Z in lower case."""
    return [h for (h,) in hashed_words(texts, True, word_hash)]


def suffixes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Retained suffixes of a text: position, hash of the SHARED words from there, and what orders equal ones by what
    follows and then by what stands before.

    These have 16 bits each of the hashes of the next (or last) four STEP words, so that suffixes sort as sequences of steps.

    The retained positions are the first least GRAM-word hash of each window, so every MIN_WORDS-word passage has the
    same ones wherever it stands, the first of them with SHARED words of the passage after it.
    """
    n = len(hashes)
    none = np.empty(0, np.int64)
    if n < MIN_WORDS:
        return none, none, none, none
    rolling, at = Rolling(hashes), np.arange(n - GRAM + 1)
    grams = rolling.of(at, at + GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    chosen = np.unique(windows.argmin(1) + np.arange(len(windows)))
    chosen = chosen[chosen + SHARED <= n]
    rest = np.zeros(len(chosen), np.uint64)
    for i in range(4):
        a, b = chosen + SHARED + i * STEP, chosen + SHARED + (i + 1) * STEP
        rest = rest << np.uint64(16) | np.where(b <= n, rolling.of(np.minimum(a, n), np.minimum(b, n)) >> np.uint64(48), np.uint64(0))
    left = np.zeros(len(chosen), np.uint64)
    for i in range(4):
        a, b = chosen - (i + 1) * STEP, chosen - i * STEP
        left = left << np.uint64(16) | np.where(a >= 0, rolling.of(np.maximum(a, 0), np.maximum(b, 0)) >> np.uint64(48), np.uint64(0))
    return chosen, rolling.of(chosen, chosen + SHARED).view(np.int64), rest.view(np.int64), left.view(np.int64)


def matches(x: np.ndarray, y: np.ndarray, shifts: set[int]) -> set[tuple[int, int, int]]:
    """Extends anchors left and right: (start in x, start in y, words) of at least MIN_WORDS. Anchors come as their shifts,
    position in y less position in x: those of one shift extend to the same matches.

    Shifts of long overlaps come first; one whose words all lie in matches already, on both sides, is left out, as it
    adds no word. So two equal texts of one repeated word cost one comparison and not one a word.
    """
    out = set()
    bare_x, bare_y = np.ones(len(x), bool), np.ones(len(y), bool)
    places = []
    for shift in shifts:
        i, j = max(0, -shift), max(0, shift)
        places.append((min(len(x) - i, len(y) - j), i, j))
    for n, i, j in sorted(places, reverse=True):
        if not bare_x[i : i + n].any() and not bare_y[j : j + n].any():
            continue
        unlike = np.flatnonzero(np.concatenate([[True], x[i : i + n] != y[j : j + n], [True]]))
        lengths = np.diff(unlike) - 1
        long = lengths >= MIN_WORDS
        for s, length in zip(unlike[:-1][long].tolist(), lengths[long].tolist(), strict=True):
            out.add((i + s, j + s, length))
            bare_x[i + s : i + s + length] = bare_y[j + s : j + s + length] = False
    return out


def neighbours(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in sorted suffixes: each suffix and the nearest before it of another document with the same key; for
    the first document of a key, the nearest after it."""
    n = len(h)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    run = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [n]]) - 1
    place = np.arange(n)
    before = np.where(run > 0, last[run - 1], -1)
    ok = (before >= 0) & (h[np.maximum(before, 0)] == h)
    after = np.where(run + 1 < len(first), first[np.minimum(run + 1, len(first) - 1)], -1)
    alone = ~ok & (after >= 0) & (h[np.maximum(after, 0)] == h)
    return np.concatenate([place[ok], place[alone]]), np.concatenate([before[ok], after[alone]])


#: Rows of :func:`linked`: pairs; rows of a partition's first run, whose neighbour before may lie in an earlier partition;
#: rows whose neighbour after may lie in a later one; runs at the edges of a partition.
PAIR, HEAD, TAIL, RUN = range(4)


def linked(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """``kind, a, pa, b, pb, h``: :func:`neighbours` over the batches (key, document, position) of a sorted partition.

    A run is the rows of one key and document that lie together. Between batches the last rows of the last two runs are
    held, and of a run that has no run of its key before it, all positions, until the run after it is seen.
    HEAD and TAIL rows have no ``b``. RUN rows are the first two and the last two runs: document, first position, place
    among these, last position.
    """
    runs: list[list[int]] = []  # h, doc, first position, last position
    count = 0
    pending: list[np.ndarray] = []

    def same(value: int, n: int) -> np.ndarray:
        return np.full(n, value, np.int64)

    for h, doc, pos in batches:
        n = len(h)
        if not n:
            continue
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.concatenate([first[1:], [n]]) - 1
        goes_on = bool(runs) and runs[-1][:2] == [h[0], doc[0]]
        held = [(r[0], r[1], r[3]) for r in runs[-2:]]
        old = len(held)
        ch, cd, cp = (np.concatenate([np.array(o, np.int64), c]) for o, c in zip(zip(*held, strict=True) if held else [()] * 3, (h, doc, pos), strict=True))
        i, j = neighbours(ch, cd)
        opening = int(last[0]) + 1 if count == 0 or (count == 1 and goes_on) else 0
        if opening:
            yield HEAD, doc[:opening], pos[:opening], same(0, opening), same(0, opening), int(h[0])
        new = i >= old + opening
        yield PAIR, cd[i[new]], cp[i[new]], cd[j[new]], cp[j[new]], 0
        if pending and not (goes_on and len(first) == 1):
            k = int(first[1]) if goes_on else 0
            if h[k] == runs[-1][0]:
                for p in pending:
                    yield PAIR, same(runs[-1][1], len(p)), p, same(doc[k], len(p)), same(pos[k], len(p)), 0
            pending = []
        before = h[first[-1] - 1] if len(first) > 1 else runs[-2 if goes_on else -1][0] if not opening else h[-1]
        if before != h[-1]:
            pending.append(pos[first[-1] :].copy())
        if goes_on:
            runs[-1][3] = int(pos[last[0]])
        fresh = range(int(goes_on), len(first))
        for r in sorted({*fresh[:2], *fresh[-2:]}):
            runs.append([int(h[first[r]]), int(doc[first[r]]), int(pos[first[r]]), int(pos[last[r]])])
        count += len(fresh)
        runs = runs if len(runs) <= 4 else runs[:2] + runs[-2:]
    for p in pending:
        yield TAIL, same(runs[-1][1], len(p)), p, same(0, len(p)), same(0, len(p)), runs[-1][0]
    for place, (key, d, start, stop) in enumerate(runs):
        yield RUN, same(d, 1), same(start, 1), same(place, 1), same(stop, 1), key


def outside(runs: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``part, kind, b, pb``: what HEAD and TAIL rows of each partition pair with, from the RUN rows of all (partition,
    place, key, document, first and last position)."""
    whole: list[list[int]] = []  # key, document, first and last position of runs joined over partitions
    of: dict[int, list[int]] = {}
    for part, _, h, doc, start, stop in sorted(runs):
        if whole and whole[-1][:2] == [h, doc]:
            whole[-1][3] = stop
        else:
            whole.append([h, doc, start, stop])
        of.setdefault(part, []).append(len(whole) - 1)
    out = []
    for part, own in of.items():
        for kind, r in ((HEAD, own[0]), (TAIL, own[-1])):
            if r and whole[r - 1][0] == whole[r][0]:
                out.append((part, kind, whole[r - 1][1], whole[r - 1][3]))
            elif r + 1 < len(whole) and whole[r + 1][0] == whole[r][0]:
                out.append((part, kind, whole[r + 1][1], whole[r + 1][2]))
    return out


def _neighbours(array: DataFrame, order: list[str]) -> DataFrame:
    """``a, pa, b, pb``: :func:`neighbours` of all suffixes of a staged table, in an order that begins with the key ``h``."""
    spark = array.sparkSession
    ordered = array.repartitionByRange(*order).sortWithinPartitions(*order)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part = ["a", "pa", "b", "pb", "h", "kind", "part"], TaskContext.get().partitionId()
        for kind, a, at, b, to, h in linked([batch.column(c).to_numpy() for c in ("h", "doc", "pos")] for batch in batches):
            columns = [a, at, b, to, *(np.full(len(a), c, np.int64) for c in (h, kind, part))]
            yield pa.record_batch([pa.array(c) for c in columns], names=names)

    found = stage(ordered.select("h", "doc", "pos").mapInArrow(paired, "a long, pa long, b long, pb long, h long, kind long, part long"), "neighbours")
    runs = found.where(F.col("kind") == RUN).select("part", "b", "h", "a", "pa", "pb").collect()
    pairs = found.where(F.col("kind") == PAIR).select("a", "pa", "b", "pb")
    across = outside([tuple(r) for r in runs])
    if across:
        ends = spark.createDataFrame(across, "part long, kind long, b long, pb long")
        pairs = pairs.unionByName(found.drop("b", "pb").join(F.broadcast(ends), ["part", "kind"]).select("a", "pa", "b", "pb"))
    return pairs


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc, start, stop, later``: spans of words, of at least MIN_WORDS each, that other documents hold, too.

    Words are what stands between ASCII white space, A-Z in lower case. ``later`` marks spans found in a document of a
    smaller key; dropping those leaves each passage once. Spans of a document can overlap. Passages that repeat only
    within a document, or within rows of one key, don't count. Rows whose key or text is null take no part.

    1. Suffixes at minimiser positions are keyed by hashes of the words that follow.
    2. All suffixes are sorted by range; neighbours that share SHARED words and lie in different documents are pairs.
       A key of very many suffixes spans partitions (its rows are told apart by what follows, document and place); what
       rows at the edges of a partition pair with is found on the driver from four runs a partition.
    3. Pairs of documents are joined to the pieces of their texts that the suffixes lie in, and each match is extended left and
       right. One that reaches the end of a piece, and meets no other there, goes on in a round of longer pieces.
    """
    spark = bounded(docs.sparkSession)
    source = docs.select(as_long(docs, key).alias("key"), column(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    fields = ["h", "x", "l", "doc", "pos"]

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for doc, words in zip(batch.column("key").to_pylist(), words_of(batch.column("text")), strict=True):
            pos, h, x, left = suffixes(words)
            parts.append((h, x, left, np.full(len(pos), doc, np.int64), pos))
        return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=fields)

    array = stage(map_batches(source, keyed, "h long, x long, l long, doc long, pos long"), "suffixes")
    # Neighbours by what follows, then by what stands before: a passage that goes on to the left has its own nearest one.
    pairs = _neighbours(array, ["h", "x", "doc", "pos"]).unionByName(_neighbours(array, ["h", "l", "doc", "pos"]))
    swap = F.col("a") > F.col("b")
    turned = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b", "a"), ("pb", "pa"), ("a", "b"), ("pa", "pb"))]
    anchors, spans, links, size, margin = pairs.select(*turned), None, None, PIECE, MARGIN
    while True:
        found = stage(_extended(source, anchors, size, margin), "matches")
        new = found.where(F.col("later").isNotNull()).select("doc", "start", "stop", "later")
        spans = new if spans is None else spans.unionByName(new)
        cut = found.where(F.col("later").isNull()).select(F.col("doc").alias("a"), "b", "shift", "start", "stop", "left", "right")
        links = stage(_whole(cut if links is None else links.withColumns({"left": F.lit(False), "right": F.lit(False)}).unionByName(cut)), "links")
        at = F.explode(F.filter(F.array(F.when(F.col("left"), F.col("start")), F.when(F.col("right"), F.col("stop") - 1)), lambda x: x.isNotNull()))
        anchors = links.where("left OR right").select("a", "b", "shift", at.alias("pa")).select("a", "pa", "b", (F.col("pa") + F.col("shift")).alias("pb"))
        if anchors.isEmpty():
            return spans
        needed = stage(anchors.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "long")
        source, size, margin = source.join(needed, "key", "left_semi"), size * LONGER, margin * LONGER


def _pieces(source: DataFrame, size: int, margin: int) -> DataFrame:
    """``doc, piece, first, more, text``: each ``size`` words of a text with ``margin`` words on either side, the place of its
    first word, and whether words follow it. A text of up to ``size`` words is one piece."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bool, str]] = []
        for doc, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = text.encode().split() if len(text) > size else []
            if len(words) <= size:
                rows.append((doc, 0, 0, False, text))
            else:
                for k in range(-(-len(words) // size)):
                    start, stop = max(0, k * size - margin), (k + 1) * size + margin
                    rows.append((doc, k, start, stop < len(words), b" ".join(words[start:stop]).decode()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "piece", "first", "more", "text"])

    return map_batches(source.select("key", "text"), cut, "doc long, piece long, first long, more boolean, text string")


def _extended(source: DataFrame, anchors: DataFrame, size: int, margin: int) -> DataFrame:
    """``doc, start, stop, later``: both sides of the matches of at least MIN_WORDS through the anchors ``a, pa, b, pb``.

    An anchor sees the pieces of both texts that it lies in, so a text is not sent whole to all that it has a passage in
    common with. Of texts in several pieces come the matches themselves, too (``later`` null, ``doc`` and ``b`` the texts,
    ``shift``), and whether they end, ``left`` or ``right``, where a piece does and the text doesn't.
    """
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    couples = anchors.groupBy("a", at("pa").alias("ka"), "b", at("pb").alias("kb")).agg(F.collect_set(F.col("pb") - F.col("pa")).alias("shifts"))
    texts_of = _pieces(source, size, margin)
    side = lambda d, k, f, m, t: texts_of.select(*[F.col(c).alias(n) for c, n in zip(("doc", "piece", "first", "more", "text"), (d, k, f, m, t), strict=True)])
    both = couples.join(side("a", "ka", "fa", "ma", "x"), ["a", "ka"]).join(side("b", "kb", "fb", "mb", "y"), ["b", "kb"])

    def extended(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, (left, right) = once(batch.column("x"), batch.column("y"))
        words = by_text(*coded_words(texts, True)[:2])  # equal words of a batch have equal places
        out = set()
        for a, b, shifts, fa, fb, ma, mb, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shifts", "fa", "fb", "ma", "mb")), left, right, strict=True):
            for i, j, n in matches(words[x], words[y], {s + fa - fb for s in shifts}):
                p, q = fa + i, fb + j
                out |= {(a, p, p + n, False, None, None, None, None), (b, q, q + n, True, None, None, None, None)}
                if fa or fb or ma or mb:
                    cut = p > 0 and q > 0 and (i == 0 or j == 0)
                    end_x, end_y = i + n == len(words[x]), j + n == len(words[y])
                    goes_on = (end_x or end_y) and not (end_x and not ma) and not (end_y and not mb)
                    out.add((a, p, p + n, None, b, q - p, cut, goes_on))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "start", "stop", "later", "b", "shift", "left", "right"])

    rows = both.select("a", "b", "shifts", "fa", "fb", "ma", "mb", "x", "y")
    return map_batches(rows, extended, "doc long, start long, stop long, later boolean, b long, shift long, left boolean, right boolean")


def _whole(cut: DataFrame) -> DataFrame:
    """Matches of two texts and one shift that meet are one; it has the ends, open or not, of the outermost."""
    by = ["a", "b", "shift"]
    along = W.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(along.rowsBetween(W.unboundedPreceding, -1))
    begins = cut.withColumn("begins", F.when(F.col("start") <= before, 0).otherwise(1))
    runs = begins.withColumn("run", F.sum("begins").over(along.rowsBetween(W.unboundedPreceding, 0)))
    # Of ends at one place one that isn't open is the truth.
    ends = runs.groupBy(*by, "run").agg(F.min(F.struct("start", "left")).alias("l"), F.max(F.struct("stop", (~F.col("right")).alias("closed"))).alias("r"))
    return ends.select(*by, "l.start", "r.stop", "l.left", (~F.col("r.closed")).alias("right"))


def merged(spans: DataFrame) -> DataFrame:
    """``doc, spans`` (sorted, disjoint array<struct<start, stop>>): overlapping spans of a document are one."""
    gathered = spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("s"))
    kind = "array<struct<start:bigint,stop:bigint>>"

    def join(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (s["start"] <= F.get(done, F.size(done) - 1)["stop"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return gathered.select("doc", F.aggregate("s", F.array().cast(kind), join).alias("spans"))


def drop_repeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with all but the first occurrence of a repeated passage cut out of ``text`` (words joined by spaces where cut).

    A pass cuts what has an earlier neighbour; passes go on until none is left, a few for very many copies.
    """
    while True:
        later = stage(merged(repeated_passages(docs, text, key).where("later")), "later")
        if later.isEmpty():
            return docs
        docs = stage(_cut(docs, later, text, key), "cut")


def _cut(docs: DataFrame, later: DataFrame, text: str, key: str) -> DataFrame:
    keep, stem = docs.columns, free_stem(docs)
    found = later.select(F.col("doc").alias(stem + "doc"), F.col("spans").alias(stem + "spans"))
    joined = docs.join(found, column(key) == F.col(stem + "doc"), "left")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, spans in zip(batch.column(text).to_pylist(), batch.column(stem + "spans").to_pylist(), strict=True):
            if t is not None and spans:
                words = t.encode().split()
                for s in reversed(spans):
                    del words[s["start"] : s["stop"]]
                t = b" ".join(words).decode()
            out.append(t)
        return pa.record_batch([pa.array(out, pa.string()) if c == text else batch.column(c) for c in keep], names=keep)

    return map_batches(joined.select(*quoted(keep), stem + "spans"), cut, schema_text(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_suffix_dedup``: for each document, the spans of words that other documents repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = merged(repeated_passages(docs))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return docs.select("doc_id", word_count(F.col("text")).alias("n_words")).join(spans, F.col("doc_id") == F.col("doc"), "left").select(
        "doc_id", "n_words", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce(length, F.lit(0)).cast("long").alias("n_repeated"), "spans"
    )
