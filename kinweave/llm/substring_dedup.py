"""Repeated spans of words by compacting a de Bruijn graph of token k-mers.

The edges of the graph are the windows of `span` consecutive words. They are not
shuffled one by one: as in minimizer-partitioned de Bruijn construction, the
consecutive windows that share their least k-mer form one block (a super-k-mer),
and equal windows always lie in blocks of the same k-mer.

1. k-mers are counted; blocks of k-mers met once hold no repeated window.
2. Blocks with equal words are a class. A class met twice or more is repeated as
   a whole. A class met once, whose k-mer has other classes, is the end of a
   repeated region: it is opened and its windows are compared one by one with
   those of one member of each other class, weighted by the class's size.
3. Whole repeated blocks that always follow one another are joined (Spark joins
   on their source coordinates) and compact to nonbranching paths; each document
   then holds a few long spans instead of many edges.
4. The source coordinates are read again: every occurrence of a path must have
   the same words, by a second, independent hash.
5. Words that a span or a single repeated window covers are removed.

Words are maximal runs of bytes other than blank and tab to carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinweave.llm import _flat
from kinweave.llm._flat import carried
from kinweave.operators.components import connected_components
from kinweave.plans.storage import Written, release, written

_SEPARATORS = _flat.separators("space")


def _least(value: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of `width` values from each place."""
    at = np.arange(len(value))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        n = len(value) - step
        left = value[:n] <= value[step:]
        value, at = np.where(left, value[:n], value[step:]), np.where(left, at[:n], at[step:])
        reach += step
    return at


class _Prefix:
    """Hashes of short runs of words (some 60 at most), by prefix sums in a base of
    its own for each of the word hashes; `seed` picks the functions."""

    def __init__(self, words: _flat.Words, seed: int):
        self.powers = [p.of(len(words.start) + 1) for p in _flat.POWERS]
        self.sums = []
        for i, (h, (up, _)) in enumerate(zip(words.hash, self.powers)):
            s = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(_flat.mix(h + np.uint64(seed + i)) * up[: len(h)], out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> list[np.ndarray]:
        tail = np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return [_flat.mix((s[start + length] - s[start]) * down[start] + tail).view(np.int64) for s, (_, down) in zip(self.sums, self.powers)]


def _run_hashes(words: _flat.Words, seed: int, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Hashes of runs of any length: each place has a random odd factor of its own."""
    if not len(start):
        return [np.zeros(0, np.int64) for _ in words.hash]
    heads = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(heads, length)
    at = np.repeat(start, length) + place
    out = []
    for i, h in enumerate(words.hash):
        factor = _flat.mix(place.astype(np.uint64) + np.uint64((seed + i) * 1_000_003)) | np.uint64(1)
        sums = np.add.reduceat(_flat.mix(h[at] + np.uint64(seed + i)) * factor, heads)
        out.append(_flat.mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
    return out


def _word_chunks(batch: pa.RecordBatch, column: int, seed: int = 0) -> Iterator[tuple[int, int, _flat.Words, np.ndarray, np.ndarray]]:
    data, offsets = _flat.utf8(batch.column(column))
    for i, j in _flat.chunks(offsets):
        at = offsets[i : j + 1]
        own = data[at[0] : at[-1]]
        yield i, j, _flat.Words(own, at - at[0], _SEPARATORS, seed=101 + 31 * seed, hashes=2), own, at - at[0]


def _blocks(span: int, k: int, only_kmers: bool, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, words, _, _ in _word_chunks(batch, 1, seed):
                if len(words.start) < span:
                    continue
                kmers = _flat.grams(words.hash[0], k, seed=7)
                least = _least(kmers, span - k + 1)  # by window start
                owner = np.repeat(np.arange(len(words.of) - 1), np.diff(words.of))
                starts = np.flatnonzero(owner[: len(least)] == owner[span - 1 :])
                if not len(starts):
                    continue
                m = least[starts]
                # k-mers of a window lie in it, so blocks never cross texts
                head = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (np.diff(starts) != 1)]))
                first, n = starts[head], np.diff(np.append(head, len(starts)))
                kmer = pa.array(kmers[m[head]].view(np.int64))
                if only_kmers:
                    yield pa.RecordBatch.from_arrays([kmer], names=["kmer"])
                    continue
                hi, lo = _Prefix(words, 41).of(first, n + span - 1)
                doc = owner[first]
                yield pa.RecordBatch.from_arrays(
                    [kmer, pa.array(hi), pa.array(lo), batch.column(0).take(pa.array(i + doc)), pa.array((first - words.of[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["kmer", "hi", "lo", "row", "start", "n"],
                )

    return run


_READ = "kind int, hi long, lo long, copies long, row binary, start int, n int, w1 long, w2 long"


def _read_sources(span: int, seed: int):
    """kind 0: all windows of a block, one row each; kind 1: a span's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, asked = batch.column(1), batch.column(2)
            for i, j, words, _, _ in _word_chunks(batch, 0, seed):
                lists = asked.slice(i, j - i)
                flat = lists.flatten()
                owner = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
                kind, hi, lo, copies, start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "hi", "lo", "copies", "start", "n"))
                again = _Prefix(words, 977)
                own = row.slice(i, j - i).take(pa.array(owner))
                at = words.of[owner] + start
                for what in (0, 1):
                    pick = np.flatnonzero(kind == what)
                    times = n[pick] if what == 0 else np.ones(len(pick), np.int64)
                    pick = np.repeat(pick, times)
                    step = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                    w1, w2 = again.of(at[pick] + step, span) if what == 0 else _run_hashes(words, 977, at[pick], n[pick].astype(np.int64) + span - 1)
                    columns = [pa.array(c) for c in (kind[pick], hi[pick], lo[pick], copies[pick], (start[pick] + step).astype(np.int32), n[pick], w1, w2)]
                    yield pa.RecordBatch.from_arrays([*columns[:4], own.take(pa.array(pick)), *columns[4:]], names=[c.split(" ")[0] for c in _READ.split(", ")])

    return run


def _remove(span: int, layout: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spans = batch.column(1).fill_null(""), batch.column(2)
            n_words, n_removed, kept = [], [], []
            for text, drop in zip(column, spans):
                words = text.as_py().encode().split()
                n_words.append(len(words))
                if not drop.is_valid:
                    n_removed.append(0)
                else:
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = drop.values.field("start").to_numpy(zero_copy_only=False)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + drop.values.field("n").to_numpy(zero_copy_only=False) + span - 1, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    words = list(compress(words, keep.tolist()))
                    n_removed.append(n_words[-1] - len(words))
                kept.append(text.as_py() if layout and not n_removed[-1] else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), batch.column(3)], names=["id", "n_words", "n_removed", "kept_text", "rest"]
            )

    return run


#: Blocks whose k-mer has more than a share of 1 / HOT of all blocks (so fewer than HOT
#: k-mers) are dealt over SALTS partitions, and so are equal blocks of such a share. Fewer
#: than LEAST are never dealt.
HOT, SALTS, LEAST = 1000, 64, 1000


def repeated_spans(keyed: DataFrame, span: int = 35, k: int = 8, seed: int = 0) -> DataFrame:
    """(row, start, n): the windows start .. start + n - 1 of the text are
    repeated. keyed: row binary (a key of the whole row), text.

    Null and empty texts and texts of fewer than `span` words give no rows, nor does
    an empty table; rows with equal keys are rows of their own, which repeat each
    other and share their spans."""
    texts = keyed.select("row", "text")
    counted = Written(texts.mapInArrow(_flat.trimmed(_blocks(span, k, True, seed)), "kmer long").groupBy("kmer").count().filter("count > 1"), "kmers")
    total = counted.df.agg(F.sum("count")).first()[0] or 0
    many = max(total // HOT, LEAST)
    hot = counted.df.filter(F.col("count") > many).select("kmer", F.lit(True).alias("hot"))  # fewer than HOT rows
    salts = lambda n: F.explode(F.when(n > many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int")).otherwise(0)
    kmers = counted.df.select("kmer", salts(F.col("count")))
    blocks = texts.mapInArrow(_flat.trimmed(_blocks(span, k, False, seed)), "kmer long, hi long, lo long, row binary, start int, n int").join(F.broadcast(hot), "kmer", "left")
    dealt = blocks.withColumn("salt", salt).drop("hot")
    blocks_held = Written(dealt.join(kmers, ["kmer", "salt"]).drop("salt"), "blocks")
    release(keyed.sparkSession)
    held = blocks_held.df

    classes = held.groupBy("hi", "lo", "kmer", "n").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start")).alias("at"))
    mixed = classes.groupBy("kmer").agg(F.count("*").alias("classes"), F.min("copies").alias("least")).filter("classes > 1 and least = 1").select("kmer")
    opened = classes.join(mixed, "kmer").select(F.lit(0).alias("kind"), "hi", "lo", "copies", "at.row", "at.start", "n")

    whole = classes.filter("copies > 1").select("hi", "lo", "copies", salts(F.col("copies")))
    common = classes.filter(F.col("copies") > many).select("hi", "lo", F.lit(True).alias("hot"))  # fewer than HOT rows, too
    dealt = held.select("hi", "lo", "row", "start", "n").join(F.broadcast(common), ["hi", "lo"], "left").withColumn("salt", salt).drop("hot")
    repeated_held = Written(dealt.join(whole, ["hi", "lo", "salt"]).distinct().drop("salt"), "repeated")  # a row's salt is the same in all its repeats
    release(keyed.sparkSession)
    repeated = repeated_held.df
    name = F.col("hi")  # a path's label only: the words were compared by both hashes
    ends = repeated.select(name.alias("a"), F.col("copies").alias("a_copies"), "row", (F.col("start") + F.col("n")).alias("start"))
    follow = ends.join(repeated.select(name.alias("b"), F.col("copies").alias("b_copies"), "row", "start"), ["row", "start"])
    links = follow.groupBy("a", "b", "a_copies", "b_copies").count().filter("count = a_copies and count = b_copies and a != b")
    paths = connected_components(links.select("a", "b"))
    on_path = repeated.withColumn("a", name).join(paths.withColumnRenamed("node", "a"), "a", "left").withColumn("path", F.coalesce("component", "a"))
    order = Window.partitionBy("row").orderBy("start")
    fresh = F.when((F.lag("path").over(order) == F.col("path")) & (F.lag(F.col("start") + F.col("n")).over(order) == F.col("start")), 0).otherwise(1)
    islands = on_path.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = written(
        islands.groupBy("row", "island").agg(
            F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min_by("hi", "start").alias("hi"), F.min_by("lo", "start").alias("lo"), F.first("copies").alias("copies")
        ).drop("island"), "spans",
    )
    release(keyed.sparkSession)

    asked = opened.unionByName(spans.select(F.lit(1).alias("kind"), "hi", "lo", "copies", "row", "start", "n"))
    lists = asked.groupBy("row").agg(F.collect_list(F.struct("kind", "hi", "lo", "copies", "start", "n")).alias("asked"))
    read = written(texts.join(lists.hint("shuffle_hash"), "row").select("text", "row", "asked").mapInArrow(_flat.trimmed(_read_sources(span, seed)), _READ), "sources")
    release(keyed.sparkSession)
    for table in (counted, blocks_held, repeated_held):
        table.drop()

    differ = read.filter("kind = 1").groupBy("hi", "lo", "n").agg(F.min(F.struct("w1", "w2")).alias("x"), F.max(F.struct("w1", "w2")).alias("y")).filter("x != y")
    if not differ.isEmpty():
        return repeated_spans(keyed, span, k, seed + 1)  # two different spans had equal hashes: other hash functions
    windows = read.filter("kind = 0").select("hi", "lo", "copies", "row", "start", "w1", "w2").distinct()
    shared = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("total")).filter("total > 1")
    single = windows.filter("copies = 1").join(shared, ["w1", "w2"]).select("row", "start", F.lit(1).alias("n"))
    return spans.select("row", "start", "n").unionByName(single)


def substring_dedup(
    docs: DataFrame, span: int = 35, k: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), layout: bool = False
) -> DataFrame:
    """Removes each word that lies in a window of `span` words whose sequence
    also starts elsewhere, in another text or in the same one.

    Returns one row per input row: id, n_words, n_removed, kept_text (the words
    kept, joined by one blank; with `layout`, texts that lose none as they are) and
    the columns named in `carry`. Windows are judged on the input. Null and empty
    texts have no words; texts of fewer than `span` words lose none. Equal rows
    are rows of their own, and so repeat each other. An empty table gives no
    rows. Other columns are ignored.
    """
    if not 0 < k < span:
        raise ValueError("k must lie between 1 and span - 1")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), carried(docs, carry))
    keyed = base.withColumn("row", _flat.row_key())
    spans = written(repeated_spans(keyed, span, k).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "cuts")
    release(docs.sparkSession)
    kind = StructType().add("id", "long").add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add(base.schema["rest"])
    cut = keyed.join(spans.hint("shuffle_hash"), "row", "left").select("id", "text", "spans", "rest").mapInArrow(_flat.trimmed(_remove(span, layout)), kind)
    return cut.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text", *(F.col("rest").getField(f"c{i}").alias(c) for i, c in enumerate(carry)))
