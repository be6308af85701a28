"""BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import PIECES, SPACES, ChunkEncoder, WordEncoder
from .common import map_batches, quoted, schema_text, without

VOCABULARY = "word_bpe_49k.json"
#: Bytes of texts that are encoded at once.
SLICE_BYTES = 4 << 20

WHITE = regex.compile(rf"[{SPACES}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairIndexBpe:
    """A BPE vocabulary with word ends, applied to many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + end] for x in letters]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        self.ranks = {a << 20 | b: r for r, (a, b, _) in enumerate(self.rules)}
        self.special = {k.encode(): v for k, v in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        size = 1 + max(*vocab.values(), *special.values())
        self.tokens = [""] * size
        for k, v in [*vocab.items(), *special.items()]:
            self.tokens[v] = k
        self.chunks = ChunkEncoder(WordEncoder(self.encode_words, self.encode_raw).encode_new)

    def pieces(self, text: str) -> list[bytes]:
        """Normalised words of a text without special tokens, in UTF-8."""
        if text.isascii():
            text = text.lower()
        else:
            text = WHITE.sub(" ", unicodedata.normalize("NFC", text))
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return [x.encode() for x in PIECES.findall(text)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.merge([w.encode() for w in words])]

    def encode_raw(self, chunks: list[str]) -> list[bytes]:
        """Chunks with special tokens, or that are normalised by :meth:`pieces` alone."""
        out = []
        for chunk in chunks:
            ids = array("i")
            for part in self.cut.split(chunk):
                if (found := self.special.get(part.encode())) is not None:
                    ids.append(found)
                else:
                    for made in self.merge(self.pieces(part)):
                        ids.extend(made)
            out.append(ids.tobytes())
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. All words lie in one chain of symbols; ``where`` maps a rank (a pair) to its positions.

        The lowest active rank is applied at all its positions, left to right; each merge adds the two pairs that it
        makes to their lists. A made pair of lower rank goes first (a symbol can come from more than one pair).
        """
        ranks, rules = self.ranks, self.rules
        symbols: list[int] = []
        starts = []
        for w in words:
            starts.append(len(symbols))
            symbols.extend(map(self.inner.__getitem__, w[:-1]))
            symbols.append(self.final[w[-1]])
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts:
            before[s] = -1
            if s:
                after[s - 1] = -1
        if n:
            after[n - 1] = -1
        where: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (r := ranks.get(symbols[i] << 20 | symbols[j])) is not None:
                where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            at = where.pop(rank, None)
            if at is None:
                continue
            at.sort()
            first, second, new = rules[rank]
            for done, i in enumerate(at):
                j = after[i]
                if symbols[i] != first or j < 0 or symbols[j] != second:
                    continue
                symbols[i], symbols[j] = new, -1
                k, h = after[j], before[i]
                after[i] = k
                lower = False
                if k >= 0:
                    before[k] = i
                    if (r := ranks.get(new << 20 | symbols[k])) is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(active, r)
                        lower = r < rank
                if h >= 0 and (r := ranks.get(symbols[h] << 20 | new)) is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        heapq.heappush(active, r)
                    lower = lower or r < rank
                if lower:
                    where[rank] = at[done + 1 :]
                    heapq.heappush(active, rank)
                    break
        out = []
        for s in starts:
            ids = []
            while s >= 0:
                ids.append(symbols[s])
                s = after[s]
            out.append(ids)
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text as bytes of int32."""
        return self.chunks.encode(texts)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, array("i", ids)))


_models: dict[str, PairIndexBpe] = {}


def model(path: str) -> PairIndexBpe:
    if path not in _models:
        _models[path] = PairIndexBpe(path)
    return _models[path]


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", decode: bool = True) -> DataFrame:
    """Token ids of every whole text and, if asked for, the text that decoding them gives.

    ``path``: the vocabulary file, which every worker can read (default: the public word-level BPE). Returns the
    columns of ``docs`` with ``ids`` array<int> and ``decoded`` string (null without ``decode``); these replace columns
    of the same names. A null or empty text, or one of white space, has no ids and decodes to "". Strings of special
    tokens in a text become their ids, and nothing is added. Equal rows stay rows.

    Scale: a narrow map, no shuffle. A slice of about 4 MB is encoded at once; each worker remembers the ids of
    frequent chunks, so most words cost a lookup.
    """
    path = path or default_path()
    keep = without(docs, "ids", "decoded")
    schema = schema_text(docs.select(*quoted(keep))) + ", ids array<int>, decoded string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = model(path)
        ids = bpe.encode(batch.column(text))
        flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        decoded = pa.array([bpe.decode(x) for x in ids] if decode else [None] * len(ids), pa.string())
        return pa.record_batch([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), flat), decoded], names=[*keep, "ids", "decoded"])

    return map_batches(docs.select(*quoted(keep)), run, schema, SLICE_BYTES)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_bpe``: every whole text encoded, then decoded."""
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
