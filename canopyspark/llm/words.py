"""Hashes of words and of runs of words, as NumPy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words remembered in a worker at most, where a value is dear; the memory starts anew beyond that.
REMEMBERED = 100_000


class Remembered(dict):
    """word -> value, computed where it isn't known."""

    def __init__(self, of: Callable[[bytes], int]):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes) -> int:
        value = self.of(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))



class Computed:
    """word -> value, computed each time: for values that cost no more than looking them up."""

    def __init__(self, of: Callable[[bytes], int]):
        self.of = of

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of, words), np.uint64, len(words))


word_hash = Computed(xxhash.xxh64_intdigest)


def coded_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts of a column as places in a dictionary: where each text starts, the places, the dictionary.

    Words stand between ASCII white space; with ``lower``, A-Z first become lower case. Null texts have no words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    starts = lists.offsets.to_numpy()
    starts, place = starts - starts[0], coded.indices.to_numpy()
    empty = coded.dictionary.index("").as_py()  # at either end of a text
    if empty >= 0:
        keep = place != empty
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        place = place[keep]
    return starts, place, coded.dictionary


def by_text(starts: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]


def hashed_words(texts: pa.Array, lower: bool, *of: Remembered | Computed) -> list[tuple[np.ndarray, ...]]:
    """For each text of a column, the values of its words in order, an array for each of ``of``; null texts have no words.

    Words are those of :func:`coded_words`; distinct words of the column are looked up once.
    """
    starts, place, dictionary = coded_words(texts, lower)
    words = dictionary.cast(pa.binary()).to_pylist()
    return list(zip(*(by_text(starts, f.array(words)[place] if len(words) else np.empty(0, np.uint64)) for f in of), strict=True))


def once(*columns: pa.Array) -> tuple[pa.Array, list[list[int]]]:
    """The distinct texts of some columns, and the places of each column's among them."""
    coded = pa.concat_arrays([pc.fill_null(c, "") for c in columns]).dictionary_encode()
    place, out, at = coded.indices.to_pylist(), [], 0
    for c in columns:
        out.append(place[at : at + len(c)])
        at += len(c)
    return coded.dictionary, out


_MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_HALF, _SHIFT = np.uint64(32), np.uint64(29)


def scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads small differences over all bits."""
    x = (x ^ (x >> _HALF)) * _FOLD
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _HALF)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence as one run where it is shorter; none of no words."""
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        n = len(hashes)
    count = len(hashes) - n + 1
    out = np.full(count, np.uint64(n))
    for i in range(n):
        out = scatter(out * _MIX + hashes[i : i + count])
    return out
