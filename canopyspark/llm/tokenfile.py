"""Token files: documents compressed one by one with a shared zstandard dictionary, and an index to reach each."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, WordEncoder
from .common import as_long, bounded, bounded_sample, column, new_path, pieces

#: Rows that the dictionary is trained on, and its size in bytes: the bounds of what reaches the driver.
TRAINING_ROWS, TRAINING_CHARS, DICTIONARY_BYTES = 1000, 20_000, 32 << 10
BLOCK_BYTES = 1 << 20
# magic, bytes an id, dictionary hash, documents
HEAD = struct.Struct("<4sIQQ")
MAGIC = b"CTK1"
BLOCKS = "part int, block int, first long, n_docs long, n_tokens long, dictionary long, lo long, hi long, body binary"

_encoders: dict[tuple[str, str], ChunkEncoder] = {}


#: Times the usual number of chunks and words remembered.
MEMORY = 3.75
#: New words that the library gets in one text.
TOGETHER = 512


class LibraryEncoder:
    """Ids of words and chunks by the tokenizers library, as bytes of ``dtype``.

    New words go to the library together in one text; the token that ends a word says where to cut its ids.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype(dtype)
        self.final = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.final[i] = token.endswith("</w>")

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def raw(self, chunks: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self.library(chunks)]

    def words(self, words: list[str]) -> list[bytes]:
        out, width = [], self.dtype.itemsize
        for ids in self.library([" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]):
            data, start = ids.tobytes(), 0
            for stop in ((np.flatnonzero(self.final[ids]) + 1) * width).tolist():
                out.append(data[start:stop])
                start = stop
        return out


def encoder(path: str, dtype: str) -> ChunkEncoder:
    if (path, dtype) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, dtype] = ChunkEncoder(WordEncoder((library := LibraryEncoder(path, dtype)).words, library.raw, MEMORY).encode_new, MEMORY)
    return _encoders[path, dtype]


def id_type(path: str) -> str:
    """The narrowest of 16 and 32 bits that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def dictionary_hash(dictionary: bytes) -> int:
    return xxhash.xxh64_intdigest(dictionary)


def pack(doc_ids: list[int | None], lengths: list[int], frames: list[bytes], width: int, hashed: int) -> bytes:
    """One block: head, ids of documents (and which are null), tokens of each, offsets of the frames, frames."""
    return b"".join([
        HEAD.pack(MAGIC, width, hashed, len(frames)),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u4").tobytes(),
        np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes(),
        *frames,
    ])


class Block:
    """Reads a block; any document of it alone, too."""

    def __init__(self, body: bytes, dictionary: bytes):
        magic, self.width, hashed, self.n = HEAD.unpack_from(body)
        if magic != MAGIC or hashed != dictionary_hash(dictionary):
            raise ValueError("not a block of this dictionary")
        at, n = HEAD.size, self.n
        null = np.frombuffer(body, "u1", n, at)
        ids = np.frombuffer(body, "<i8", n, at + n)
        self.doc_ids = [None if z else int(x) for z, x in zip(null, ids, strict=True)]
        self.lengths = np.frombuffer(body, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(body, "<u8", n + 1, at + 13 * n)
        self.body, self.at = memoryview(body), at + 13 * n + 8 * (n + 1)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def tokens(self, i: int) -> np.ndarray:
        frame = self.body[self.at + int(self.offsets[i]) : self.at + int(self.offsets[i + 1])]
        raw = self.unpacker.decompress(frame, max_output_size=max(1, int(self.lengths[i]) * self.width))
        return np.frombuffer(raw, f"<u{self.width}")


def train(docs: DataFrame, path: str, dtype: str, text: str, key: str) -> bytes:
    """A dictionary from at most TRAINING_ROWS rows, chosen by hash of the key (empty if they are too few to train on).

    Of a text of more than TRAINING_CHARS code points a window of as many counts, which begins anywhere in it. Only the
    compression depends on the dictionary.
    """
    body, h = F.coalesce(column(text), F.lit("")), F.xxhash64(column(key))
    spare = F.greatest(F.char_length(body) - TRAINING_CHARS, F.lit(0))
    window = F.substring(body, (F.pmod(F.xxhash64(h), spare + 1) + 1).cast("int"), F.lit(TRAINING_CHARS))
    rows = bounded_sample(docs.select(window.alias("t"), h.alias("h")), TRAINING_ROWS).collect()
    samples = [x for x in encoder(path, dtype).encode([r.t for r in rows]) if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 1, text: str = "text", key: str = "doc_id") -> None:
    """Encode all texts with the tokenizers library and write them in ascending order of ``key`` below ``out``.

    ``out/dictionary`` holds the dictionary, ``out/blocks`` rows of blocks (see :func:`pack`) with the tokens before
    each in its partition; both go through Spark's writers, so any store will do and a lost task is written anew.
    A null text is empty; each document ends with ``end_id``. Null keys come first; rows of equal keys lie together,
    ordered by a hash of the text. Rows are range-partitioned by both, so that one key can't fill a task unless its
    texts are equal. A key that isn't an integer raises a TypeError before anything is written.
    """
    number = as_long(docs, key)
    spark, dtype = bounded(docs.sparkSession), id_type(path)
    dictionary = train(docs, path, dtype, text, key)
    hashed = dictionary_hash(dictionary)
    signed = hashed - (1 << 64) if hashed >> 63 else hashed
    spark.createDataFrame(pa.table({"hash": pa.array([signed], pa.int64()), "dictionary": pa.array([dictionary], pa.binary())})).coalesce(1).write.parquet(f"{out}/dictionary")
    width = int(dtype[-1])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, dtype).encode
        end = np.array([end_id], dtype).tobytes()
        packer = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        lengths: list[int] = []
        frames: list[bytes] = []

        def made() -> pa.RecordBatch:
            n = sum(lengths)
            known = [k for k in keys if k is not None]
            row = [part, block, first, len(keys), n, signed, min(known, default=None), max(known, default=None), pack(keys, lengths, frames, width, hashed)]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.binary()]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        size = 0
        for some in pieces(batches, 10 << 20):
            for k, ids in zip(some.column("key").to_pylist(), encode(some.column("text")), strict=True):
                frame = packer.compress(ids + end)
                keys.append(k)
                lengths.append(len(ids) // width + 1)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield made()
                    block, first, size = block + 1, first + sum(lengths), 0
                    keys, lengths, frames = [], [], []
        if keys:
            yield made()

    body = F.coalesce(column(text), F.lit(""))
    rows = docs.select(number.alias("key"), body.alias("text"), F.xxhash64(body).alias("tie"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{out}/blocks")


def read_tokens(spark: SparkSession, out: str, only: list[int] | None = None) -> DataFrame:
    """All documents of token files: ``doc_id, start`` (tokens of all documents before it), ``ids`` array<int>.

    With ``only``, just the documents of these keys: the scan skips blocks by their least and largest key, and of the
    others' frames those of the keys alone are decompressed.
    """
    return _read(spark, out, "ids array<int>", lambda ids: ids.astype(np.int32), only)


def _read(spark: SparkSession, out: str, field: str, of: object, only: list[int] | None = None) -> DataFrame:
    bounded(spark)
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first().dictionary)
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a partition
    before = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    schema = f"doc_id long, start long, n_tokens long, {field}"
    name, kind = field.split()
    arrow = pa.list_(pa.int32()) if kind == "array<int>" else pa.int64()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column("body")[i].as_py(), dictionary)
                start = batch.column("at")[i].as_py() + np.cumsum([0, *block.lengths[:-1].tolist()])
                places = [j for j in range(block.n) if wanted is None or block.doc_ids[j] in wanted]
                values = pa.array([of(block.tokens(j)) for j in places], arrow)
                yield pa.record_batch([pa.array([block.doc_ids[j] for j in places], pa.int64()), pa.array(start[places], pa.int64()), pa.array(block.lengths[places].astype(np.int64)), values], names=["doc_id", "start", "n_tokens", name])

    wanted = None if only is None else frozenset(only)
    if only is not None:
        near = F.lit(False)
        for k in sorted(wanted):
            near = near | ((F.col("lo") <= k) & (F.col("hi") >= k))
        blocks = blocks.where(near)
    return blocks.join(before, "part").select((F.col("before") + F.col("first")).alias("at"), "body").mapInArrow(read, schema)


def read_checksums(spark: SparkSession, out: str) -> DataFrame:
    """As :func:`read_tokens`, with ``ids_crc32`` (of the ids as unsigned 32-bit integers) in place of the ids."""
    return _read(spark, out, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_token_files``: all documents written to token files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = new_path(spark, "tokens")
    write_tokens(docs, out, public_tokenizers.path("word_bpe_49k.json"))
    return read_checksums(spark, out)
