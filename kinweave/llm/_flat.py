"""Whole batches of texts as flat numpy arrays.

Texts stay UTF-8 bytes in one buffer, as Arrow hands them over; words are found
and hashed for all texts of a batch at once. Everything is a pure function of
the bytes, so two executors always agree.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_BASE = 0x9E3779B97F4A7C15 | 1

#: Bytes of text worked on at a time; a longer single text is one chunk.
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    spare = np.right_shift(x, np.uint64(30))
    x ^= spare
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=spare)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=spare)
    return x


def random_u64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers of a counter and a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_BASE))


#: Places of a run that have random numbers of their own; later places mix them anew.
_DEPTH = 64


@functools.lru_cache(maxsize=8)
def _places(seed: int) -> np.ndarray:
    return random_u64(_DEPTH * 256, seed)


def run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the byte runs at ascending `starts`. Each byte adds a random
    number of its place and value (tabulation), so that no rule in the order of the
    bytes makes runs collide, as it does in polynomials modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    own = data[starts[0] :]
    room = np.diff(np.append(starts - starts[0], len(own)))
    place = np.arange(len(own), dtype=np.int32)
    place -= np.repeat((starts - starts[0]).astype(np.int32), room)
    value = _places(seed)[(place & (_DEPTH - 1)) << 8 | own]
    if (room != sizes).any():
        value[place >= np.repeat(sizes.astype(np.int32), room)] = 0
    if sizes.max() > _DEPTH:
        late = np.flatnonzero((place >= _DEPTH) & (value != 0))
        value[late] = mix(value[late] + (place[late] >> 6).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return mix(np.add.reduceat(value, starts - starts[0]) + sizes.astype(np.uint64) * np.uint64(_BASE))


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, for hashes of short
    windows by prefix sums."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > KEPT_POWERS:
            return self._of(n)  # for one long text, and not kept
        if len(self.up) < n:
            self.up, self.down = self._of(KEPT_POWERS)
        return self.up, self.down

    def _of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


KEPT_POWERS = (1 << 20) + 1
POWERS = (Powers(_BASE), Powers(0xC2B2AE3D27D4EB4F))


def give_back() -> None:
    """Gives memory that is free to the system, which allocators do not by themselves."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives free memory back to the system when its task
    ends: workers live on from task to task, beside those of other stages."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def separators(kind: str) -> np.ndarray:
    """True for bytes that end a word: 'alnum' keeps 0-9, a-z, A-Z and all
    non-ASCII bytes in words; 'space' parts at blank and tab to carriage return."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    elif kind == "alnum":
        table[:128] = True
        for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
            table[ord(a) : ord(b) + 1] = False
    else:
        raise ValueError(kind)
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of a chunk of texts: byte ranges, 64-bit hashes, and `of`,
    where text i has the words of[i] to of[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, seed: int = 1, hashes: int = 1):
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1 : n + 1] = ~sep[data]
        first, last = inside[1 : n + 1] & ~inside[:n], inside[1 : n + 1] & ~inside[2:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] |= inside[1 : n + 1][heads]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[tails] |= inside[1 : n + 1][tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)
        self.hash = [run_hashes(data, self.start, self.end - self.start, seed + 7919 * i) for i in range(hashes)]


def grams(h: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Hash of the k words from each place of the flat array; the last k - 1
    places of each text straddle and are for the caller to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = random_u64(k, seed) | np.uint64(1)
    out = h[:n] * c[0]
    for i in range(1, k):
        out += h[i : i + n] * c[i]
    return mix(out)


def carried(docs: DataFrame, columns: Sequence[str]) -> Column:
    """The columns that only pass through an operator, as the struct `rest`, whose
    fields have names of their own, so that no name can clash."""
    return F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(columns)), F.lit(0).alias("none")).alias("rest")


def row_key(id_col: str = "id", text_col: str = "text", rest_col: str = "rest") -> Column:
    """What rows are told apart by: 128 bits of id, text and the carried columns.
    Rows with equal keys are equal in all that an operator returns."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.to_json(rest_col), F.coalesce(text_col, F.lit("")))))
