"""N-gram Jaccard join by MinHash banding.

1. One Arrow pass gives each text the 128-bit hash of its set of word n-grams
   and its band hashes. Texts with the same set form a class at once, with
   partial aggregation, so groups of exact copies never grow.
2. Classes that share a band hash are candidates. Bands are counted before they
   are expanded, and each bucket adds only a star of edges, so a hot bucket adds
   as many rows as it has members. Components of that graph are the groups
   within which every pair is verified.
3. Each candidate's full n-gram set travels to its group once. A group of more
   than BLOCK_ROWS classes or BLOCK_GRAMS n-grams is cut into blocks, and each
   pair of blocks is a task of its own: memory stays bounded, nothing is dropped.
   Pairs are compared inside the task; it returns link counts and a spanning
   forest, never the pairs.

A text's words are maximal runs of 0-9, a-z and non-ASCII characters after A-Z
are lower-cased. Texts of fewer than n words have one n-gram, all their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm import _flat
from kinweave.operators.components import connected_components
from kinweave.plans.storage import written

#: Classes and n-grams in a block of a group; a task holds two blocks at most.
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1 << 20


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows per band, and so the fewest false candidates,
    with which a pair at the threshold shares a band with probability `recall`
    and bands * rows stays within max_hashes."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold must be in (0, 1], recall in (0, 1)")
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"recall {recall} at {threshold} takes more than {max_hashes} hashes")
    return best


def gram_sets(words: _flat.Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a chunk."""
    h = words.hash[0]
    g = _flat.grams(h, n)
    for a, e in zip(words.of[:-1], words.of[1:]):
        if e - a >= n:
            yield np.unique(g[a : e - n + 1])
        elif e > a:
            short = h[a:e] * (_flat.random_u64(n, 17)[: e - a] | np.uint64(1))
            yield _flat.mix(np.array([short.sum(dtype=np.uint64) + np.uint64(e - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_key(grams: np.ndarray) -> bytes:
    """128-bit hash of a set of n-grams."""
    a = _flat.mix(grams).sum(dtype=np.uint64)
    b = _flat.mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


class MinHash:
    """Band hashes of sets of 64-bit values. The values are mixed already, so a
    random odd factor, a bijection, is hash function enough."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.mul = _flat.random_u64(bands * rows, 11).astype(np.uint32) | np.uint32(1)
        self.coef = _flat.random_u64(rows, 13) | np.uint64(1)

    def __call__(self, flat: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """flat: the values of all sets, each set beginning at its head and not
        empty. One row of band hashes per set."""
        x = (flat >> np.uint64(32)).astype(np.uint32)
        least, hashed = np.empty((self.bands * self.rows, len(heads)), np.uint32), np.empty_like(x)
        for k, mul in enumerate(self.mul):
            np.multiply(x, mul, out=hashed)
            np.minimum.reduceat(hashed, heads, out=least[k])
        start = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        by_band = least.reshape(self.bands, self.rows, len(heads))
        h = np.repeat(start[:, None], len(heads), axis=1)
        for r in range(self.rows):  # all bands at a time: sets are few, and each call costs
            h += by_band[:, r] * self.coef[r]
        return np.ascontiguousarray(_flat.mix(h).T)


def _chunks_of(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, _flat.Words]]:
    data, offsets = _flat.utf8(batch.column(text))
    sep = _flat.separators("alnum")
    for i, j in _flat.chunks(offsets):
        at = offsets[i : j + 1]
        yield i, j, _flat.Words(_flat.lower_ascii(data[at[0] : at[-1]]), at - at[0], sep)


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            for i, j, words in _chunks_of(batch, 3):
                sets = list(gram_sets(words, n))
                full = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets], np.int64)
                values, offsets = np.zeros(0, np.int64), np.zeros(j - i + 1, np.int32)
                if full:
                    heads = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
                    values = minhash(np.concatenate(full), heads).view(np.int64).ravel()
                    offsets[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    names=["id", "row", "n", "cls", "size", "bands"],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for i, j, words in _chunks_of(batch, 0):
                found = [(i + k, s.tobytes()) for k, s in enumerate(gram_sets(words, n)) if len(s) and set_key(s) == wanted[i + k]]
                keep = pa.array([k for k, _ in found], pa.int64())
                rest = pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in range(1, batch.num_columns)], names=batch.schema.names[1:])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([s for _, s in found], pa.binary())], names=[*rest.schema.names, "grams"])

    return run


def intersections(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the sizes of its intersections with all of the sets."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    value = np.cumsum(head) - 1
    starts = np.flatnonzero(head)
    counts = np.diff(np.append(starts, len(ranked)))
    holders = owner[order]
    if float((counts.astype(float) ** 2).sum()) * 3e-9 <= n * n * float((counts > 1).sum()) * 6e-11 + 1e-3:
        inverse = np.empty(len(flat), np.int64)
        inverse[order] = value
        at = 0
        for i, s in enumerate(sets):
            v = inverse[at : at + len(s)]
            at += len(s)
            c = counts[v]
            spots = np.repeat(starts[v] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
            yield i, np.bincount(holders[spots], minlength=n)
        return
    dense = np.zeros((n, n), np.float32)  # exact: counts stay under 2**24
    shared = np.flatnonzero(counts > 1)
    column = np.full(len(counts), -1)
    column[shared] = np.arange(len(shared))
    col = column[value]
    rows, cols = holders[col >= 0], col[col >= 0]
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(cols, [lo, lo + 4096])
        m = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
        m[rows[a:b], cols[a:b] - lo] = 1
        dense += m @ m.T
    own = np.array([len(s) for s in sets])
    for i in range(n):
        row = dense[i].astype(np.int64)
        row[i] = own[i]
        yield i, row


def _verify(names: list[bytes], block: np.ndarray, copies: np.ndarray, apart: bool, sets: list[np.ndarray], threshold: float) -> list[tuple[bytes, bytes | None, int]]:
    """How many rows each class links with, and a spanning forest of the links;
    `apart`: only classes of different blocks are compared."""
    size = np.array([len(s) for s in sets])
    links, parent, out = np.zeros(len(sets), np.int64), list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, common in intersections(sets):
        near = common / (size[i] + size - common) >= threshold
        near[i] = False
        if apart:
            near &= block != block[i]
        links[i] = copies[near].sum()
        for j in np.flatnonzero(near[:i]):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((names[i], names[int(j)], 0))
    return out + [(n, None, int(k)) for n, k in zip(names, links) if k]


def verify_sorted(threshold: float):
    """Links of rows (component, p, q, cls, block, copies, grams) that are dealt and
    sorted by (component, p, q): a class that repeated rows send more than once is
    held once, and no more than one pair of blocks is held beside a batch."""

    def found(key: tuple, rows: dict[bytes, tuple]) -> list[tuple[bytes, bytes | None, int]]:
        if len(rows) < 2:
            return []
        block, copies, grams = zip(*rows.values())
        return _verify(list(rows), np.array(block), np.array(copies), key[1] != key[2], [np.frombuffer(g, np.uint64) for g in grams], threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for batch in batches:
            out = []
            component, p, q, cls, block, copies = (batch.column(c).to_pylist() for c in range(6))
            for i, name in enumerate(cls):
                if (mine := (component[i], p[i], q[i])) != key:
                    out += found(key, rows)
                    key, rows = mine, {}
                rows.setdefault(name, (block[i], copies[i], batch.column(6)[i].as_py()))
            yield _links(out)
        yield _links(found(key, rows))

    return run


def _links(out: list[tuple[bytes, bytes | None, int]]) -> pa.RecordBatch:
    a, b, links = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], names=["a", "b", "links"])


def row_hash(id_col: str, text_col: str) -> Column:
    """What rows are told apart by: a 64-bit hash of id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
    threshold: float = 0.8, recall: float = 0.99999, max_hashes: int = 96, row_col: str | None = None,
) -> DataFrame:
    """Documents whose sets of word n-grams have a Jaccard similarity of at least
    `threshold`.

    Returns one row per input row: id, class_id (smallest id among texts with the
    same n-gram set), n_links (other rows linked directly, copies included),
    component_id (smallest id reachable by links), kept (exactly one row per
    component: the first by id, nulls last, then by `row_hash`; of rows equal in id
    and text any one) and, if `row_col` names it, the row_hash.

    Null and word-free texts link with nothing, so all of them are kept. Rows with equal id are told apart
    by their text. A null id never becomes class_id or component_id while the
    class has another one. An empty table gives no rows. Other columns of the
    input are ignored.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = base.select("id", row_hash("id", "text").alias("row"), "text")
    numbered = keyed.select("id", "row", F.monotonically_increasing_id().alias("n"), "text")  # tells equal rows apart once it is written
    signed = written(numbered.mapInArrow(_flat.trimmed(_signatures(n, bands, rows)), "id long, row long, n long, cls binary, size long, bands array<long>"), "signatures")

    classes = (
        signed.filter("cls is not null").groupBy("cls")
        .agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "n")).alias("first"))
    )
    banded = classes.select("cls", F.posexplode("bands").alias("band", "hash")).select("cls", F.xxhash64("band", "hash").alias("bucket"))
    stars = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cls").alias("b")).filter("n > 1").drop("n")
    candidates = connected_components(banded.join(stars, "bucket").filter("cls != b").select(F.col("cls").alias("a"), "b").distinct())

    members = written(candidates.withColumnRenamed("node", "cls").join(classes.select("cls", "row", "copies", "size"), "cls"), "members")
    groups = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    placed = members.join(groups.select("component", blocks.alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    sets = (
        keyed.join(placed.select("row", "cls", "component", "copies", "blocks", "block").hint("shuffle_hash"), "row")
        .select("text", "cls", "component", "copies", "blocks", "block")
        .mapInArrow(_flat.trimmed(_sets(n)), "cls binary, component binary, copies long, blocks int, block int, grams binary")
    )
    spread = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cls", "component", "copies", "block", "grams", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")
    )
    dealt = spread.select("component", "p", "q", "cls", "block", "copies", "grams").repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")
    found = written(dealt.mapInArrow(_flat.trimmed(verify_sorted(threshold)), "a binary, b binary, links long"), "links")

    linked = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    joined = connected_components(found.filter("b is not null").select("a", "b"))
    named = joined.withColumnRenamed("node", "cls").join(classes.select("cls", "class_id", "first"), "cls")
    smallest = named.groupBy("component").agg(F.min("class_id").alias("component_id"), F.min("first").alias("component_first"))
    labels = named.join(smallest, "component").select("cls", "component_id", "component_first").join(linked, "cls", "left")
    per_class = classes.select("cls", "class_id", "copies", "first").join(labels, "cls", "left").select(
        "cls", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("component_first", "first").getField("n").alias("first_n"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return signed.select("id", "row", "n", "cls").join(per_class, "cls", "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("n") == F.col("first_n"), F.lit(True)).alias("kept"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )
