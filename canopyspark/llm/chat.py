"""Chat formatting: conversations rendered by a template, encoded once with offsets, and a loss mask aligned with the tokens."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, as_long, bounded, column, give_back, map_batches, pieces, stage

#: Marks around a turn, by role; other roles stand in the text between theirs, as a JSON string on a line of its own.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[/TURN]")
LEARNT = "assistant"
#: What texts must not contain as it is: the marks, and the special token of the vocabulary.
CONTROLS = [*(m for pair in MARKS.values() for m in pair), *OTHER, "<|endoftext|>"]
#: A control string with any number of backslashes after its first sign: a text has one more of them when it is rendered.
GUARD = re.compile("|".join(rf"(?<={re.escape(c[0])})\\*(?={re.escape(c[1:])})" for c in CONTROLS))
GUARDED = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
RESTS = [c[1:] for c in CONTROLS]
ROLES = {pair[0]: role for role, pair in MARKS.items()} | {OTHER[0]: None}
CLOSED = {opened: closed for opened, closed in [*MARKS.values(), OTHER]}
OPENED = re.compile("|".join(map(re.escape, ROLES)))

#: Turns from which a conversation may be dealt over tasks, code points of a row of output, of a piece to encode and of what is encoded together.
LONG_TURNS, ROW_CHARS, PIECE_CHARS, TOGETHER = 4096, 1 << 20, 1 << 18, 1 << 18
#: Where a text may be cut without a change of its tokens: a space after something else.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) ")
FORMATTED = "conv_id long, segment long, n_turns int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    return GUARD.sub(lambda m: m[0] + "\\", text) if any(r in text for r in RESTS) else text


def unescape(text: str) -> str:
    return GUARDED.sub("", text) if any(r in text for r in RESTS) else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The turns (role, text) as one string, and where the texts to learn stand in it, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        opened, closed = MARKS.get(role, OTHER)
        head = opened if role in MARKS else f"{opened}{escape(json.dumps(role, ensure_ascii=False))}\n"
        body = escape(text)
        out += [head, body, closed]
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(closed)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered string."""
    turns, at = [], 0
    while at < len(formatted):
        opened = OPENED.match(formatted, at)
        stop = formatted.find(CLOSED[opened[0]], opened.end()) if opened else -1
        if stop < 0:
            raise ValueError(f"no turn at {at}")
        role, body = ROLES[opened[0]], formatted[opened.end() : stop]
        if role is None:
            name, _, body = body.partition("\n")
            role = json.loads(unescape(name))
        turns.append((role, unescape(body)))
        at = stop + len(CLOSED[opened[0]])
    return turns


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The vocabulary's tokenizer, in which each mark is one token, so that no token reaches over the end of a text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    made.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in CONTROLS if made.token_to_id(m) is None])
    return made


def cuts(text: str) -> list[int]:
    """Where the pieces of about PIECE_CHARS begin, and the end. A text without a place to cut is one piece."""
    at = [0]
    while len(text) - at[-1] > PIECE_CHARS and (m := CUT.search(text, at[-1] + PIECE_CHARS)):
        at.append(m.start())
    return [*at, len(text)]


def encode(texts: list[str], path: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the ids and where their code points begin and end."""
    places = [cuts(t) for t in texts]
    encoded = iter(tokenizer(path).encode_batch([t[a:b] for t, p in zip(texts, places, strict=True) for a, b in zip(p, p[1:], strict=False)], add_special_tokens=False))
    out = []
    for place in places:
        ids, offsets = [], []
        for start in place[:-1]:
            e = next(encoded)
            ids.append(np.array(e.ids, np.int32))
            offsets.append(np.array(e.offsets, np.int32).reshape(-1, 2) + start)
        both = np.concatenate(offsets)
        out.append((np.concatenate(ids), both[:, 0], both[:, 1]))
    return out


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a code point with one of the spans, which are sorted and apart: a binary search for each token."""
    a, b = np.array(spans, np.int64).reshape(-1, 2).T
    first = np.searchsorted(b, starts, side="right")  # the first span that ends behind the token's start
    return np.append(a, np.iinfo(np.int64).max)[first] < ends


def masked(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """The text under the mask, unescaped: the union of the tokens' places, in order, each stretch by itself."""
    s, e = starts[loss], np.maximum.accumulate(ends[loss]) if loss.any() else ends[loss]
    if not len(s):
        return ""
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return "".join(unescape(formatted[i:j]) for i, j in zip(s[new].tolist(), e[np.append(new[1:] - 1, len(e) - 1)].tolist(), strict=True))


def format_conversations(rows: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered conversations with token ids, the code points ``starts`` to ``ends`` that each token stands for in ``formatted``, and ``loss``.

    Turns go by ``turn`` (null first), those of one turn by a hash of role and text, equal ones in any order. A null text
    or role is empty, a null ``conv_id`` is a conversation like others; repeated rows are turns of their own. ``loss``
    marks the tokens of assistants' texts (not their marks). Other columns are not used. An empty table gives none.

    A conversation is one row, or several where it has over ROW_CHARS code points or over LONG_TURNS turns: its rows by
    ``segment`` are its turns in order, and a row holds whole turns. So nothing grows with a conversation: those of many
    turns, and all of a null ``conv_id``, are sorted over all tasks, the others meet in the task of their key. Marks are
    tokens of their own, so parts of a conversation have the same tokens apart as together. A piece of text without
    white space is encoded as a whole, however long.
    """
    spark = bounded(rows.sparkSession)
    value = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    rows = rows.select(as_long(rows, conv).alias("conv"), column(turn).alias("turn"), value(role).alias("role"), value(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    many = stage(rows.where("conv IS NOT NULL").groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG_TURNS).select("conv"), "many")
    short, long, n = rows.where("conv IS NOT NULL"), rows.where("conv IS NULL"), many.count()
    if n:
        side = F.broadcast(many) if n <= HOT_KEYS else many
        short, long = short.join(side, "conv", "left_anti"), long.unionByName(rows.join(side, "conv", "left_semi"))
    short = short.repartition("conv").sortWithinPartitions("conv", "turn", "tie")
    long = long.withColumn("own", F.monotonically_increasing_id()).repartitionByRange("conv", "turn", "tie", "own").sortWithinPartitions("conv", "turn", "tie")
    columns = ["conv", "role", "text"]

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rendered(batches)
        finally:
            give_back()

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ready: list[tuple[int | None, list[tuple[str, str]]]] = []
        turns: list[tuple[str, str]] = []
        now, size, waiting = None, 0, 0
        for some in pieces(batches, 1 << 20):
            for of, who, what in zip(*(some.column(c).to_pylist() for c in columns), strict=True):
                if turns and (of != now or size >= ROW_CHARS):
                    ready.append((now, turns))
                    waiting, turns, size = waiting + size, [], 0
                now = of
                turns.append((who, what))
                size += len(what)
            if waiting >= TOGETHER or len(ready) >= 4096:
                yield _rows(ready, path, number)
                number, ready, waiting = number + len(ready), [], 0
        if turns:
            ready.append((now, turns))
        if ready:
            yield _rows(ready, path, number)

    made = [part.select(*columns).mapInArrow(formatted, FORMATTED) for part in (short, long)]
    return made[0].unionByName(made[1])


def _rows(ready: list[tuple[int | None, list[tuple[str, str]]]], path: str, number: int) -> pa.RecordBatch:
    rendered = [render(turns) for _, turns in ready]
    encoded = encode([text for text, _ in rendered], path)
    at = np.cumsum([0, *(len(ids) for ids, _, _ in encoded)]).astype(np.int32)
    lists = lambda parts, kind: pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts), kind))
    loss = [mask(s, e, spans) for (_, s, e), (_, spans) in zip(encoded, rendered, strict=True)]
    return pa.record_batch([
        pa.array([c for c, _ in ready], pa.int64()), pa.array(range(number, number + len(ready)), pa.int64()), pa.array([len(t) for _, t in ready], pa.int32()), pa.array([t for t, _ in rendered], pa.string()),
        *(lists([e[i] for e in encoded], pa.int32()) for i in range(3)), lists(loss, pa.bool_()),
    ], names=[x.split()[0] for x in FORMATTED.split(", ")])


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of each conversation, from formatted rows alone.

    Turns come from the rendered text, the learnt text from tokens' places under the mask. A digest of a whole
    conversation needs it in order: the rows of each go through one task one by one, and none is held.
    """

    def taken(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = batch.column("formatted").to_pylist(), []
        for i, t in enumerate(texts):
            starts, ends = (batch.column(c)[i].values.to_numpy() for c in ("starts", "ends"))
            loss = batch.column("loss")[i].values.to_numpy(zero_copy_only=False)
            turns = parse(t)
            out.append((len(turns), "".join(f"{role}\n{text}\n" for role, text in turns), masked(t, starts, ends, loss), len(t)))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
        return pa.record_batch([batch.column("conv_id"), batch.column("segment"), *columns], names=["conv_id", "segment", "n_turns", "turns", "learnt", "chars"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now: list | None = None
        for some in pieces(batches):
            done = []
            for conv, n, turns, learnt, chars in zip(*(some.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "learnt", "chars")), strict=True):
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1], now[3], now[5] = now[1] + n, now[3] + len(learnt), now[5] + chars
                now[2].update(turns.encode())
                now[4].update(learnt.encode())
            if done:
                yield pa.record_batch([pa.array([x.hexdigest() if k == pa.string() else x for x in c], k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now:
            yield pa.record_batch([pa.array([x.hexdigest() if k == pa.string() else x], k) for x, k in zip(now, kinds, strict=True)], names=names)

    parts = map_batches(formatted, taken, "conv_id long, segment long, n_turns long, turns string, learnt string, chars long", 2 << 20)
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The turns of conversation -1: a text that holds control strings.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op12_chat``: all conversations, and conversation -1, formatted into the shared folder and read back."""
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(stage(format_conversations(rows.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json")), "chat"))


def _escaped_sql(text: str) -> str:
    """Marks and guards a text gets, as a length in SQL."""
    by = {c: "|".join(re.escape(x[1:]) for x in CONTROLS if x[0] == c) for c in "<["}
    for c, rests in by.items():
        text = f"regexp_replace({text}, '(\\{c}\\\\*)({rests})', '\\1\\\\\\2', 'g')" if c == "[" else f"regexp_replace({text}, '({c}\\\\*)({rests})', '\\1\\\\\\2', 'g')"
    return f"length({text})"


#: DuckDB's own version of :func:`query` for the roles of MARKS.
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({_escaped_sql('text')} + CASE role {' '.join(f"WHEN '{r}' THEN {sum(map(len, m))}" for r, m in MARKS.items())} END)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
