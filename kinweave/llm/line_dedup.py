"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard
verification and distributed union-find, keeping one line per component.

1. One Arrow pass cuts texts into lines and gives each line a 128-bit hash and its
   band hashes. Equal lines are a class, found by partial aggregation. That table,
   without any text, is written; buckets are shared band hashes of classes.
2. The lines of classes in shared buckets are read again, once, from the source
   coordinates, and sent to their buckets. Candidates are verified inside a bucket
   only, so chance candidates never chain into large groups; a pair is compared in
   the first bucket that both its lines share.
3. A bucket of more than BLOCK_ROWS lines or BLOCK_GRAMS shingles is dealt into
   blocks, each with the bucket's least class as a pivot. Only lines that pivots and
   blocks left in different components are then compared across blocks, so a large
   group of near copies costs in proportion to its size, and nothing is dropped.
4. Components of verified links keep the line that comes first by (id, row, place).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinweave.llm import _flat
from kinweave.llm._flat import carried
from kinweave.llm.ngram_jaccard import MinHash, choose_bands, intersections
from kinweave.operators.components import connected_components
from kinweave.plans.storage import Written, release

_EDGES = " \t\r\f\v"
#: Lines and shingles in a block of a bucket; a task holds two blocks at most.
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1 << 20
#: Pairs compared at a time, and lines of a bucket from which it is compared as a matrix.
_PAIRS, _MATRIX = 1 << 18, 48


def line_key(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


#: Numbers of the code points of the first plane, and factors of rolling steps.
_LETTERS = _flat.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77))
_STEPS = _flat.random_u64(64, 23) | np.uint64(1)


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    """A number for the k values from each place, by doubling."""
    out, width, power, size, step = None, 0, x, 1, 0
    while k >> step:
        if k >> step & 1:
            out = power if out is None else out[: len(power) - width] * _STEPS[2 * step] + power[width:]
            width += size
        if k >> (step + 1):
            power = power[: len(power) - size] * _STEPS[2 * step + 1] + power[size:]
            size *= 2
        step += 1
    return out


def shingles(text: str, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, heads) of the k-character shingles of non-empty lines of these sizes
    that stand one after another in text; a line shorter than k is one shingle."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.cumsum(sizes) - sizes
    letters = _LETTERS[np.minimum(code, len(_LETTERS) - 1)]
    rare = np.flatnonzero(code >= len(_LETTERS))
    letters[rare] = _flat.mix(code[rare].astype(np.uint64) + np.uint64(77))
    n = np.maximum(sizes - k + 1, 1)
    heads = np.cumsum(n) - n
    inside = np.ones(len(code), bool)  # places where a shingle begins
    late = np.repeat(first + n, sizes - n) + np.arange(int((sizes - n).sum())) - np.repeat(np.cumsum(sizes - n) - (sizes - n), sizes - n)
    inside[late] = False
    value = _windows(np.concatenate([letters, np.zeros(k - 1, np.uint64)]), k)[inside]
    short = np.flatnonzero(sizes < k)
    for i in short.tolist():
        own = np.concatenate([letters[first[i] : first[i] + sizes[i]], np.zeros(k - sizes[i], np.uint64)])
        value[heads[i]] = _windows(own, k)[0] + np.uint64(sizes[i])
    return _flat.mix(value), heads


def _texts(column: pa.Array, limit: int = 1 << 16) -> Iterator[tuple[int, list[str]]]:
    column = column.fill_null("")
    _, offsets = _flat.utf8(column)
    for i, j in _flat.chunks(offsets, limit):  # arrays that stay in a core's cache
        yield i, column.slice(i, j - i).to_pylist()


def _key(hi: Column, lo: Column) -> Column:
    """The 16 bytes of a class or row. Tables hold them as two numbers, which hash
    aggregation can keep in place, as it cannot binary values."""
    return F.unhex(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def _signatures(k: int, bands: int, rows: int):
    names = ["id", "row_hi", "row_lo", "place", "head", "hi", "lo", "size", *_bands(bands)]
    low, number = np.uint64(_band_bits(bands)), np.arange(bands, dtype=np.uint64)

    def batch_of(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
        owner, place, keys, sizes, signature = (np.concatenate(x) for x in zip(*parts))
        row = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)[owner]
        columns = [row[:, 0], row[:, 1], place, np.diff(owner, prepend=-1) > 0, keys[:, 0], keys[:, 1], sizes, *np.ascontiguousarray(signature.T)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *map(pa.array, columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            parts: list[tuple] = []
            for i, texts in _texts(batch.column(2)):
                owner, place, lines = [], [], []
                for d, text in enumerate(texts, i):
                    own = [x.strip(_EDGES) for x in text.split("\n")]
                    at = [p for p, x in enumerate(own) if x]
                    owner += [d] * len(at)
                    place += at
                    lines += own if len(at) == len(own) else filter(None, own)
                if not lines:
                    continue
                values, heads = shingles("".join(lines), np.array([len(x) for x in lines]), k)
                keys = np.frombuffer(b"".join(map(line_key, lines)), np.int64).reshape(-1, 2)
                sizes = np.diff(np.append(heads, len(values))).astype(np.int32)
                parts.append((np.array(owner), np.array(place, np.int32), keys, sizes, ((minhash(values, heads) & ~low) | number).view(np.int64)))
            if parts:  # chunks are small, batches are not: each costs its columns
                yield batch_of(batch, parts)

    return run


def _bands(bands: int) -> list[str]:
    return [f"band{b}" for b in range(bands)]


def _band_bits(bands: int) -> int:
    """The lowest bits of a bucket, which say what band it is of."""
    return (1 << (bands - 1).bit_length()) - 1


def _asked_lines(bands: int):
    """The lines at the places that are asked for, each with its class, its buckets by
    band (0: not shared), and once each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1)
            for i, texts in _texts(batch.column(0), 1 << 19):
                lists = asked.slice(i, len(texts))
                flat, lines = lists.flatten(), []
                sizes = np.diff(lists.offsets.to_numpy()).tolist()
                places = iter(flat.field("place").to_pylist())
                for text, n in zip(texts, sizes):
                    parts = text.split("\n")
                    lines += [parts[next(places)].strip(_EDGES) for _ in range(n)]
                hot = flat.field("hot")
                entries = hot.flatten()
                owner = np.repeat(np.arange(len(flat)), np.diff(hot.offsets.to_numpy()))
                band, who = entries.field("band").to_numpy(), entries.field("who").to_numpy()
                buckets = np.zeros((len(flat), bands), np.int64)
                buckets[owner, band] = who
                once = np.flatnonzero((buckets[owner] == who[:, None]).argmax(axis=1) == band)
                named = ["who", "blocks", "pivot"]
                own = pa.StructArray.from_arrays([entries.field(c).take(pa.array(once)) for c in named], names=named)
                at = np.concatenate([[0], np.cumsum(np.bincount(owner[once], minlength=len(flat)))]).astype(np.int32)
                ends = np.arange(0, (len(flat) + 1) * bands, bands, dtype=np.int32)
                columns = [flat.field("hi"), flat.field("lo"), pa.ListArray.from_arrays(pa.array(at), own), pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.ravel())), pa.array(lines, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "hot", "buckets", "line"])

    return run


class _Sets:
    """Shingle sets of lines as one sorted array of (line, shingle), with 48 bits of a
    shingle's hash beside 16 of the line's number."""

    def __init__(self, text: str, sizes: np.ndarray, k: int):
        values, heads = shingles(text, sizes, k)
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), np.diff(np.append(heads, len(values))))
        key = np.sort((owner << np.uint64(48)) | (values >> np.uint64(16)))
        self.key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        self.at = np.searchsorted(self.key, np.arange(len(sizes) + 1, dtype=np.uint64) << np.uint64(48))
        self.size = np.diff(self.at)

    def shingles(self, i: int) -> np.ndarray:
        return self.key[self.at[i] : self.at[i + 1]] & np.uint64((1 << 48) - 1)

    def near(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs have a Jaccard similarity of at least the threshold."""
        few, many = np.where(self.size[a] <= self.size[b], a, b), np.where(self.size[a] <= self.size[b], b, a)
        out = self.size[few] >= threshold * self.size[many] * (1 - 1e-9)
        few, many, left = few[out], many[out], np.flatnonzero(out)
        ends = np.cumsum(self.size[few])
        for lo, hi in _flat.chunks(np.concatenate([[0], ends]), 1 << 21):
            x, y = few[lo:hi], many[lo:hi]
            n = self.size[x]
            heads = np.cumsum(n) - n
            own = self.key[np.repeat(self.at[x] - heads, n) + np.arange(int(n.sum()))]
            ask = (own & np.uint64((1 << 48) - 1)) | (np.repeat(y, n).astype(np.uint64) << np.uint64(48))
            spot = np.minimum(np.searchsorted(self.key, ask), len(self.key) - 1)
            common = np.add.reduceat((self.key[spot] == ask).astype(np.int64), heads)
            out[left[lo:hi]] = common / (n + self.size[y] - common) >= threshold
        return out


class _Forest:
    """Union-find over a few numbered things, whole arrays of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            if (x == y).all():
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _pairs_within(heads: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, a, b): the pairs a < b of places within groups, some at a time."""
    for n in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        groups = np.flatnonzero(sizes == n)
        step = max(1, _PAIRS // len(i))
        for at in range(0, len(groups), step):
            g = groups[at : at + step]
            yield np.repeat(g, len(i)), (heads[g][:, None] + i).ravel(), (heads[g][:, None] + j).ravel()


def _verified(rows: pa.RecordBatch, heads: np.ndarray, k: int, threshold: float) -> pa.RecordBatch:
    """A spanning forest, over classes, of the links within the groups that begin at
    heads. Where a group is one of two blocks, only rows of different blocks and
    labels are compared."""
    bucket, p, q, block, hi, lo = (rows.column(c).to_numpy() for c in range(6))
    flat = rows.column(7).flatten().to_numpy()
    shared = flat.reshape(len(rows), -1)
    lengths = pc.utf8_length(rows.column(8)).to_numpy().astype(np.int64)
    data, _ = _flat.utf8(rows.column(8))
    sets = _Sets(data.tobytes().decode(), lengths, k)
    forest = _Forest(len(rows))
    sizes = np.diff(np.append(heads, len(rows)))
    matrix = (p[heads] != q[heads]) | (sizes >= _MATRIX)
    for g, a, b in _pairs_within(heads, np.where(matrix, 0, sizes)):
        same = (shared[a] == shared[b]) & (shared[a] != 0)
        first = shared[a, same.argmax(axis=1)]
        mine = (first == bucket[heads[g]]) & (forest.root[a] != forest.root[b])  # other pairs are met elsewhere, or joined
        a, b = a[mine], b[mine]
        near = sets.near(a, b, threshold)
        forest.join(a[near], b[near])
    for g in np.flatnonzero((sizes > 1) & matrix).tolist():
        own = np.arange(heads[g], heads[g] + sizes[g])
        across = p[heads[g]] != q[heads[g]]
        if across:
            label = np.unique([x or str(i) for i, x in enumerate(rows.column(6).slice(heads[g], sizes[g]).to_pylist())], return_inverse=True)[1]
        size, mine = sets.size[own], block[own]
        for i, common in intersections([sets.shingles(x) for x in own.tolist()]):
            near = common[:i] / (size[i] + size[:i] - common[:i]) >= threshold
            if across:
                near &= (mine[:i] != mine[i]) & (label[:i] != label[i])
            j = np.flatnonzero(near)
            if len(j):
                forest.join(np.full(len(j), own[i]), own[j])
    moved = np.flatnonzero(forest.root != np.arange(len(rows)))
    to = forest.root[moved]
    return pa.RecordBatch.from_arrays([pa.array(hi[moved]), pa.array(lo[moved]), pa.array(hi[to]), pa.array(lo[to])], names=["a_hi", "a_lo", "b_hi", "b_lo"])


def _verify(k: int, threshold: float):
    """Links of rows (_ROWS) that are dealt and sorted by (bucket, p, q): groups are
    compared many at a time, and no more than a group is held beside a batch."""

    def some(rows: pa.RecordBatch, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(heads):
            _, at = _flat.utf8(rows.column(8))
            for i, j in _flat.chunks(np.append(at[heads], at[-1]) + np.append(heads, len(rows)) * 32, 1 << 17):
                end = heads[j] if j < len(heads) else len(rows)
                found = _verified(rows.slice(heads[i], end - heads[i]), heads[i:j] - heads[i], k, threshold)
                if len(found):
                    yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if left is None else pa.concat_batches([left, batch])
            new = np.zeros(len(rows), bool)
            for c in range(3):
                own = rows.column(c).to_numpy()
                new[1:] |= own[1:] != own[:-1]
            heads = np.flatnonzero(new)
            heads = np.concatenate([[0], heads])
            yield from some(rows.slice(0, heads[-1]), heads[:-1])
            left = rows.slice(heads[-1])
        if left is not None:
            yield from some(left, np.zeros(1, np.int64))

    return run


_ROWS = ["bucket", "p", "q", "block", "hi", "lo", "label", "buckets", "line"]


def _links(spread: DataFrame, k: int, threshold: float) -> DataFrame:
    dealt = spread.select(_ROWS).repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    found = dealt.mapInArrow(_flat.trimmed(_verify(k, threshold)), "a_hi long, a_lo long, b_hi long, b_lo long")
    return found.select(_key(F.col("a_hi"), F.col("a_lo")).alias("a"), _key(F.col("b_hi"), F.col("b_lo")).alias("b"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_removed, kept = [], [], []
        for text, drop, again in zip(batch.column(1).fill_null(""), batch.column(2), batch.column(3)):
            lines = text.as_py().split("\n")
            out = {p for p, x in enumerate(lines) if x.strip(_EDGES)} if again.as_py() else set(drop.as_py() or ())
            n_lines.append(len(lines))
            n_removed.append(len(out))
            kept.append("\n".join(x for p, x in enumerate(lines) if p not in out) if out else text.as_py())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), batch.column(4)], names=["id", "n_lines", "n_removed", "kept_text", "rest"]
        )


def line_dedup(docs: DataFrame, k: int = 8, threshold: float = 0.8, recall: float = 0.9995, max_hashes: int = 36, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Removes every line but the first of each component of lines whose sets of
    k-character shingles have a Jaccard similarity of at least `threshold`.

    Returns one row per input row: id, n_lines, n_removed, kept_text, and the columns
    named in `carry`. Lines part at line feeds and are compared without blanks at their
    ends; blank lines are never removed. Lines shorter than k match equal lines only.
    First is by id (null ids first), then by a hash of the row, then by place. Of rows
    equal in id, text and carried columns one keeps its lines and the others lose all
    that are not blank. Null texts count as empty. An empty table gives no rows; other
    columns are ignored. Two lines at the threshold are found with probability `recall`.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall, max_hashes)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), carried(docs, carry))
    keyed = base.withColumn("row", _flat.row_key())
    named_bands = _bands(bands)
    schema = "id long, row_hi long, row_lo long, place int, head boolean, hi long, lo long, size int, " + ", ".join(f"{b} long" for b in named_bands)
    signed = Written(keyed.select("id", "row", "text").mapInArrow(_flat.trimmed(_signatures(k, bands, rows)), schema), "signatures", plain=True)
    # one line of each class stands for it: first() takes all its columns from one row; the
    # rest is the same in all rows of a class, and max() keeps one number where first() keeps two
    told = [*(F.first(c).alias(c) for c in ("row_hi", "row_lo", "place")), *(F.max(c).alias(c) for c in ("size", *named_bands))]
    found = Written(signed.df.groupBy("hi", "lo").agg(F.count("*").alias("copies"), *told), "classes", plain=True)
    places = Written(signed.df.select("id", "row_hi", "row_lo", "place", "hi", "lo"), "lines")
    repeats = Written(signed.df.filter("head").groupBy("row_hi", "row_lo").count().filter("count > 1").select(_key(F.col("row_hi"), F.col("row_lo")).alias("row"), "count"), "repeats")
    signed.drop()
    release(spark)
    lines, classes = places.df, found.df
    repeated = not repeats.df.isEmpty()

    # one exchange and one sort give the sizes of the buckets that classes share; most
    # buckets have one class and go before the other figures are found
    whole = Window.partitionBy("bucket")
    banded = classes.select(F.explode(F.array(*named_bands)).alias("bucket"), "lo", "size").withColumn("n", F.count("*").over(whole)).filter("n > 1")
    sized = banded.select("bucket", "lo", "n", F.sum("size").over(whole).alias("grams"), F.min("lo").over(whole).alias("least"), F.bit_xor(F.xxhash64("lo")).over(whole).alias("who"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    # buckets with the same members, as the bands of two near copies mostly are, count as one
    members = Written(sized.select("lo", F.col("bucket").bitwiseAND(_band_bits(bands)).cast("int").alias("band"), F.xxhash64("who", "n", "least").alias("who"), blocks.alias("blocks"), (F.col("least") == F.col("lo")).alias("pivot")), "members")
    release(spark)

    hot = members.df.groupBy("lo").agg(F.collect_list(F.struct("band", "who", "blocks", "pivot")).alias("hot"))
    wanted = classes.select("row_hi", "row_lo", "place", "hi", "lo").join(hot.hint("shuffle_hash"), "lo").select(_key(F.col("row_hi"), F.col("row_lo")).alias("row"), "place", "hi", "lo", "hot")
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("place", "hi", "lo", "hot")).alias("asked"))
    once = keyed
    if repeated:
        once = keyed.join(repeats.df, "row", "left_anti").select("row", "text").unionByName(keyed.join(repeats.df, "row", "left_semi").select("row", "text").dropDuplicates(["row"]))
    candidates = Written(once.join(asked.hint("shuffle_hash"), "row").select("text", "asked").mapInArrow(_flat.trimmed(_asked_lines(bands)), "hi long, lo long, hot array<struct<who:long,blocks:int,pivot:boolean>>, buckets array<long>, line string"), "candidates")
    release(spark)
    each = candidates.df.select("hi", "lo", "line", "buckets", F.explode("hot").alias("x")).select("hi", "lo", "line", "buckets", F.col("x.who").alias("bucket"), "x.blocks", "x.pivot", F.pmod(F.xxhash64("hi", "lo"), F.col("x.blocks")).cast("int").alias("block"))
    everywhere = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = each.withColumn("p", F.explode(everywhere)).withColumn("q", F.col("p")).withColumn("label", F.lit(None).cast("string"))
    links = Written(_links(first, k, threshold), "links")
    release(spark)
    joined = Written(connected_components(links.df), "joined")
    large = each.filter("blocks > 1")
    if not members.df.filter("blocks > 1").isEmpty():
        named = large.withColumn("node", _key(F.col("hi"), F.col("lo"))).join(joined.df.select("node", F.hex("component").alias("label")), "node", "left")
        mixed = named.groupBy("bucket").agg(F.min(F.coalesce("label", F.hex("node"))).alias("x"), F.max(F.coalesce("label", F.hex("node"))).alias("y")).filter("x != y").select("bucket")
        others = named.join(mixed, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other != block")
        second = Written(_links(others.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")), k, threshold), "links")
        joined = Written(connected_components(links.df.unionByName(second.df)), "joined")
        second.drop()
    for table in (candidates, members, links):
        table.drop()

    named = classes.select("hi", "lo", "copies").withColumn("node", _key(F.col("hi"), F.col("lo"))).join(joined.df.hint("shuffle_hash"), "node", "left").filter("component is not null or copies > 1")
    roots = named.select("hi", "lo", F.coalesce("component", "node").alias("root"))
    linked = Written(lines.join(roots.hint("shuffle_hash"), ["hi", "lo"]).select("id", _key(F.col("row_hi"), F.col("row_lo")).alias("row"), "place", "root"), "linked")
    firsts = linked.df.groupBy("root").agg(F.min(F.struct("id", "row", "place")).alias("first")).select("first.row", "first.place")
    drops = Written(linked.df.join(firsts, ["row", "place"], "left_anti").groupBy("row").agg(F.collect_set("place").alias("drops")), "drops")
    for table in (places, found, joined, linked):
        table.drop()
    release(spark)
    source = keyed.withColumn("again", F.lit(False))
    if repeated:
        many = keyed.join(repeats.df, "row").dropDuplicates(["row"]).withColumn("again", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("count")), lambda c: c > 1))).drop("count")
        source = source.join(repeats.df, "row", "left_anti").unionByName(many)
    cut = source.join(drops.df.hint("shuffle_hash"), "row", "left").select("id", "text", "drops", "again", "rest")
    done = cut.mapInArrow(_flat.trimmed(_cut), StructType().add("id", "long").add("n_lines", "long").add("n_removed", "long").add("kept_text", "string").add(base.schema["rest"]))
    return done.select(F.col("id").alias(id_col), "n_lines", "n_removed", "kept_text", *(F.col("rest").getField(f"c{i}").alias(c) for i, c in enumerate(carry)))
