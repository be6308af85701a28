"""Token ids of texts, chunk by chunk: what stands between ASCII white space is encoded once and remembered."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Fixed values of the vocabulary's own definition: its word pattern, and what its regular expressions take as white space.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+"
PIECES = regex.compile(PATTERN)
# The same with an end of line between chunks, for any text and for lower-case ASCII.
PARTED = regex.compile(rf"\n|{PATTERN}")
PARTED_ASCII = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")

#: Chunks remembered in a worker at most, and words besides: the same word comes with many punctuation marks.
REMEMBERED, WORDS_REMEMBERED = 160_000, 80_000
#: Longer chunks (bytes) aren't remembered.
LONGEST = 64


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a column of texts, the place of each word of it among them, and where each text's words begin.

    Words stand between ASCII white space; an empty one can come at either end of a text. A null text is empty.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    starts = lists.offsets.to_numpy()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), starts - starts[0]


class Memory:
    """A bounded map: what wasn't asked for while half of the bound was filled anew is forgotten."""

    def __init__(self, bound: int):
        self.half, self.young, self.old = max(1, bound // 2), {}, {}

    def found(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of keys; those of unknown ones from one call of ``make``."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        values = list(map(young.get, keys))
        lacking = [i for i, v in enumerate(values) if v is None]
        if old:
            for i in lacking:
                values[i] = old.get(keys[i])
        new = [keys[i] for i in lacking if values[i] is None]
        made = iter(make(new) if new else ())
        for i in lacking:
            if values[i] is None:
                values[i] = next(made)
            young[keys[i]] = values[i]
        return values


def laid_out(values: list[bytes], place: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """The values at ``place`` one after another: where each begins and ends, and all of them."""
    laid = pa.array(values, pa.binary()).take(pa.array(place))
    if not len(laid):
        return np.zeros(1, np.int32), memoryview(b"")
    return np.frombuffer(laid.buffers()[1], np.int32)[laid.offset :][: len(laid) + 1], memoryview(laid.buffers()[2] or b"")


class WordEncoder:
    """Ids of chunks from ids of their words (see PATTERN), both as bytes.

    ``encode_words`` gets distinct normalised words that aren't known yet; ``encode_raw`` gets chunks that hold special
    tokens, or whose lower case isn't normalised or depends on neighbours, as they are.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], encode_raw: Callable[[list[str]], list[bytes]], times: float = 1):
        self.encode_words, self.encode_raw = encode_words, encode_raw
        self.words = Memory(int(WORDS_REMEMBERED * times))

    def encode_new(self, chunks: list[bytes]) -> list[bytes]:
        plain, wide, odd = [], [], []
        for i, c in enumerate(chunks):
            (odd if b"<|" in c else plain if c.isascii() else wide).append(i)
        texts = {i: chunks[i].decode() for i in wide}
        if not unicodedata.is_normalized("NFC", "\n".join(texts.values()).lower()) or any("\u03a3" in x for x in texts.values()):
            strange = {i for i, x in texts.items() if "\u03a3" in x or not unicodedata.is_normalized("NFC", x.lower())}
            odd += strange
            wide = [i for i in wide if i not in strange]
        out: list[bytes] = [b""] * len(chunks)
        for some, pattern in ((plain, PARTED_ASCII), (wide, PARTED)):
            if some:
                joined = b"\n".join([*(chunks[i] for i in some), b""]).decode().lower()
                for i, ids in zip(some, self._parted(pattern.findall(joined)), strict=True):
                    out[i] = ids
        if odd:
            for i, ids in zip(odd, self.encode_raw([chunks[i].decode() for i in odd]), strict=True):
                out[i] = ids
        return out

    def _parted(self, pieces: list[str]) -> list[bytes]:
        coded = pa.array(pieces).dictionary_encode()
        distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        line = distinct.index("\n")
        values = self.words.found(distinct[:line] + distinct[line + 1 :], self.encode_words)
        values.insert(line, b"")
        ends, data = laid_out(values, place)
        at = [0, *ends[np.flatnonzero(place == line) + 1].tolist()]
        return [data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


class ChunkEncoder:
    """Chunk -> its ids as little-endian bytes of one width.

    Exact for tokenizers whose words never span white space and whose normalisation looks at no neighbour across it.
    ``encode_new`` gets the distinct chunks of a batch that aren't known yet, all at once.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], list[bytes]], times: float = 1):
        self.chunks, self.encode_new = Memory(int(REMEMBERED * times)), encode_new

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text. Distinct chunks are looked up once; their ids are laid out by Arrow."""
        words, place, starts = split_words(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        values = self.chunks.found(words, self._new)
        ends, data = laid_out(values, place)
        for w in words:
            if len(w) > LONGEST:
                self.chunks.young.pop(w, None)
        at = ends[starts].tolist()
        return [data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def _new(self, chunks: list[bytes]) -> list[bytes]:
        made = self.encode_new([c for c in chunks if c])
        if b"" in chunks:
            made.insert(chunks.index(b""), b"")
        return made
