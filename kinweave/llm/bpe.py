"""Byte-level BPE encoding and decoding in batched numpy rounds.

Texts are cut into pretokens for a whole chunk at once, from the classes of
their code points. Pretokens not met before are encoded together: their bytes
lie in one flat symbol array, each round finds the lowest-rank pair of every word
by binary search over the sorted pair keys and merges all of its places. Encoded
pretokens are kept in a bounded store, found again by 64-bit hash and compared byte by byte.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import _flat

#: Pretokens and ids that the store may hold before it starts anew.
STORE_WORDS = 500_000
STORE_IDS = 4_000_000
#: Longer pretokens are not kept.
STORE_BYTES = 256
#: Bytes of text encoded at a time; a longer single text is one chunk.
ENCODE_BYTES = 1 << 20

_SLOTS = 1 << 21
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_UNKNOWN = 255
#: Code points with the Unicode property White_Space.
_WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def byte_symbols() -> dict[str, int]:
    """The public byte alphabet of byte-level BPE files: printable bytes stand
    for themselves, the others for the code points from 256, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _class_of(code: int) -> int:
    if code in _WHITE:
        return _SPACE
    return _LETTER if _IS_LETTER(chr(code)) else _NUMBER if _IS_NUMBER(chr(code)) else _OTHER


_IS_LETTER, _IS_NUMBER = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match


class ByteBpe:
    """One vocabulary file, ready for one worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], np.arange(len(keys))[order]
        self.result = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.byte_off = np.concatenate([[0], np.cumsum(lengths)])
        self.byte_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.special = {k.encode(): v for k, v in added.items()}
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self._clear()

    # -- pretokens ---------------------------------------------------------

    def _specials(self, data: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        found = []
        for word in self.special:
            at = data.find(word)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, "right"))
                inside = doc < len(offsets) and at + len(word) <= offsets[doc]
                if inside:
                    found.append((at, at + len(word)))
                at = data.find(word, at + (len(word) if inside else 1))
        return sorted(found)

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which pretokens start; they tile the texts."""
        raw = data.tobytes()
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[code]
        if (new := kind == _UNKNOWN).any():
            for c in np.unique(code[new]).tolist():
                self.classes[c] = _class_of(c)
            kind = self.classes[code]
        n = len(code)
        border = np.zeros(n + 1, bool)  # no match crosses it
        border[np.searchsorted(at, offsets[(offsets < len(data))])] = True
        border[n] = True
        specials = self._specials(raw, offsets)
        for a, b in specials:
            border[np.searchsorted(at, [a, b])] = True

        start = border[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        tail = np.zeros(n, bool)  # the last white space before something else
        tail[:-1] = space[:-1] & ~space[1:] & ~border[1:n]
        start |= tail
        start[np.flatnonzero(tail & (code == 0x20)) + 1] = False

        quote = np.flatnonzero((code[:-1] == 0x27) & start[:-1] & ~border[1:n] & (kind[1:] == _LETTER)) if n > 1 else np.zeros(0, np.int64)
        if len(quote):
            padded = np.concatenate([code, np.zeros(2, np.uint32)])
            x, y = padded[quote + 1], padded[quote + 2]
            one = np.isin(x, [ord(c) for c in "stmd"])
            two = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))) & ~border[np.minimum(quote + 2, n)]
            short = quote[one | two]
            start[short + 1] = False
            after = short + np.where(one[one | two], 2, 3)
            start[after[after < n]] = True
        for a, b in specials:
            i, j = np.searchsorted(at, [a, b])
            start[i + 1 : j] = False
        return at[start]

    # -- words -------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words that merges do not cross."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        none = len(self.rank)
        rank = np.full(len(symbol), none)
        self._rank_pairs(symbol, word, rank, np.arange(len(symbol) - 1))
        while len(symbol):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(word))))
            ready = lowest == none
            if ready.any():
                done_symbol.append(symbol[ready])
                done_word.append(word[ready])
                keep = ~ready
                symbol, word, rank, lowest = symbol[keep], word[keep], rank[keep], lowest[keep]
                if not len(symbol):
                    break
            places = np.flatnonzero(rank == lowest)
            run = np.concatenate([[True], np.diff(places) != 1])  # places of one pair may overlap: take every other
            begin = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - begin) % 2 == 0]
            symbol[places] = self.result[rank[places]]
            keep = np.ones(len(symbol), bool)
            keep[places + 1] = False
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            places -= np.arange(len(places))
            self._rank_pairs(symbol, word, rank, np.unique(np.concatenate([places, places - 1])))
        if not done_word:
            return np.zeros(0, np.uint32), np.zeros(len(words) + 1, np.int64)
        symbols, owners = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(owners, kind="stable")
        counts = np.bincount(owners, minlength=len(words))
        return symbols[order].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def _rank_pairs(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Puts into rank the rank of the pair that starts at each of `at`."""
        at = at[(at >= 0) & (at < len(symbol))]
        rank[at] = len(self.rank)
        at = at[at < len(symbol) - 1]
        at = at[word[at] == word[at + 1]]
        key = (symbol[at] << 32) | symbol[at + 1]
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[spot] == key
        rank[at[hit]] = self.rank[spot[hit]]

    # -- the store ---------------------------------------------------------

    def _clear(self) -> None:
        self.slot_key = np.zeros(_SLOTS, np.uint64)
        self.slot_word = np.full(_SLOTS, -1, np.int32)
        self.n_words = self.n_ids = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1 << 14, np.int64)
        self.len = np.zeros(1 << 14, np.int64)
        self.raw = np.zeros(1 << 16, np.uint8)
        self.raw_off = np.zeros((1 << 14) + 1, np.int64)
        for text, i in self.special.items():
            data = np.frombuffer(text, np.uint8)
            self._add(self._hashes(data, np.zeros(1, np.int64)), np.array([i], np.uint32), np.array([0, 1]), [text])

    def _hashes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _flat.run_hashes(data, starts, np.diff(np.append(starts, len(data))), 29) | np.uint64(1)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Index in the store, or -1."""
        out = np.full(len(key), -1, np.int64)
        left, slot = np.arange(len(key)), (key >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)
        while len(left):
            word = self.slot_word[slot]
            same = self.slot_key[slot] == key[left]
            out[left[same]] = word[same]
            more = ~same & (word >= 0)
            left, slot = left[more], (slot[more] + 1) & (_SLOTS - 1)
        return out

    def _add(self, keys: np.ndarray, ids: np.ndarray, offsets: np.ndarray, words: list[bytes]) -> None:
        n, m = len(keys), len(ids)
        own, begin = np.frombuffer(b"".join(words), np.uint8), int(self.raw_off[self.n_words])
        while begin + len(own) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        while self.n_words + n >= len(self.raw_off):
            self.raw_off = np.concatenate([self.raw_off, np.zeros_like(self.raw_off)])
        self.raw[begin : begin + len(own)] = own
        self.raw_off[self.n_words + 1 : self.n_words + n + 1] = begin + np.cumsum([len(w) for w in words])
        while self.n_ids + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_words + n > len(self.off):
            self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len))
        self.ids[self.n_ids : self.n_ids + m] = ids
        self.off[self.n_words : self.n_words + n] = offsets[:-1] + self.n_ids
        self.len[self.n_words : self.n_words + n] = np.diff(offsets)
        left, slot = np.arange(n), (keys >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)
        while len(left):
            free = self.slot_word[slot] < 0
            self.slot_word[slot[free]] = left[free] + self.n_words  # of several, the last stays
            won = self.slot_word[slot] == left + self.n_words
            self.slot_key[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (_SLOTS - 1)
        self.n_words += n
        self.n_ids += m

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of UTF-8 texts lying in one buffer."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self.pretokens(data, offsets)
        bytes_of = np.diff(np.append(starts, len(data)))
        keys, raw = self._hashes(data, starts), data.tobytes()
        short = bytes_of <= STORE_BYTES
        found = np.where(short, self._find(keys), 0)
        if (found < 0).any():
            new = np.flatnonzero(found < 0)
            if self.n_words + len(new) > STORE_WORDS or self.n_ids > STORE_IDS:
                distinct = len(np.unique(keys[new]))
                if self.n_words + distinct > STORE_WORDS or self.n_ids > STORE_IDS:
                    self._clear()
                    found = np.where(short, self._find(keys), 0)
                    new = np.flatnonzero(found < 0)
            fresh, first = np.unique(keys[new], return_index=True)
            words = [raw[starts[i] : starts[i] + bytes_of[i]] for i in new[first].tolist()]
            self._add(fresh, *self.encode_words(words), words)
            found[new] = self._find(keys[new])
        pool, off, sizes = self.ids, self.off[found], self.len[found]
        # words that the store does not hold, or in whose place it holds others
        at = np.minimum(np.repeat(self.raw_off[found] - starts, bytes_of) + np.arange(len(data)), len(self.raw) - 1)
        same = short & (self.raw_off[found + 1] - self.raw_off[found] == bytes_of)
        same &= np.logical_and.reduceat(self.raw[at] == data, starts)
        if not same.all():
            other = np.flatnonzero(~same)
            ids, ends = self.encode_words([raw[starts[i] : starts[i] + bytes_of[i]] for i in other.tolist()])
            off[other], sizes[other] = self.n_ids + ends[:-1], np.diff(ends)
            pool = np.concatenate([self.ids[: self.n_ids], ids])
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = pool[np.repeat(off - total[:-1], sizes) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).tobytes().decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.byte_off[ids.astype(np.int64) + 1] - self.byte_off[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.byte_flat[np.repeat(self.byte_off[ids] - total[:-1], sizes) + np.arange(total[-1])]


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One vocabulary per worker process; its store lasts from task to task."""
    return ByteBpe(path)


def encoded_batches(bpe: ByteBpe, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) for the chunks of a string column."""
    data, offsets = _flat.utf8(column)
    for i, j in _flat.chunks(offsets, ENCODE_BYTES):
        at = offsets[i : j + 1]
        ids, off = bpe.encode(data[at[0] : at[-1]], at - at[0])
        yield i, j, ids, off


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens long) of every whole text. Null and empty
    texts have no ids. `vocabulary` is the path of a byte-level BPE file with
    which every executor is provisioned. Other columns are ignored; rows with
    equal ids are rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for i, j, ids, off in encoded_batches(bpe, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(np.diff(off))], names=["id", "ids", "n_tokens"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(_flat.trimmed(run), f"id {kind}, ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of lists of ids. A null list gives the empty text, bytes that are
    not UTF-8 become U+FFFD, and ids that the vocabulary lacks, negative ones and
    nulls are skipped. Rows with equal ids are rows of their own; an empty table
    gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            known = len(bpe.byte_off) - 1
            texts = [bpe.decode(np.array([i for i in x or [] if i is not None and 0 <= i < known], np.uint32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    base = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(_flat.trimmed(run), f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids
    decoded again, as digests only, so ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for i, j, ids, off in encoded_batches(bpe, batch.column(1)):
                ends = bpe.byte_off[ids.astype(np.int64) + 1] - bpe.byte_off[ids]
                at = np.concatenate([[0], np.cumsum(ends)])[off]
                whole = bpe.decode_bytes(ids)
                own, back = [], []
                for a, e, p, q in zip(off[:-1], off[1:], at[:-1], at[1:]):
                    own.append(hashlib.sha256(ids[a:e].astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(whole[p:q].tobytes().decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(off)), pa.array(own), pa.array(back)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(_flat.trimmed(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
