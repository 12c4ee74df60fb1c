"""Best-fit packing of token sequences by a linear grouping scheme.

1. Texts are encoded on the executors; only longer ones are cut. The pieces
   (id, place, length, checksum) are a written table.
2. The plan needs the count of each length alone: at most `capacity` rows,
   whatever the input. Lengths above capacity / SMALL_SHARE are large. They are
   dealt, longest first, into equal-cardinality groups and rounded up to the
   longest of their group; a configuration programme over these few sizes is
   solved by column generation, its whole part taken, and the rest filled by best
   fit. Then actual lengths take the places of the rounded ones, and the small
   lengths go to the fullest sequence that still has room (best fit,
   decreasing). All steps work on counts, so each of them settles any number of
   like sequences.
3. A piece finds its sequence from its rank among the pieces of its length. Ranks
   are made of a rank within a (length, salt) part and the parts' running totals,
   so a length that a third of all pieces have is no task of its own.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm import _flat
from kinweave.llm.bpe import encoded_batches, load
from kinweave.plans.storage import written

#: Lengths up to capacity / SMALL_SHARE are small; groups of large lengths.
SMALL_SHARE = 8
GROUPS = 64
#: After that, sequences with at least this share of their room free (1 / n) are
#: opened and their contents go through best fit again, if that saves sequences.
REOPEN = (4, 8, 16, 32, 64, 128)


@dataclass
class Run:
    """`times` sequences with the same contents: [(length, how many of it)]."""

    times: int
    items: list[tuple[int, int]]
    room: int


def _best_configuration(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes within capacity (few fit at once)."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        nxt, pick = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            took = best[: capacity + 1 - s] + value[i]
            up = took > nxt[s:] + 1e-12
            nxt[s:][up] = took[up]
            pick[s:][up] = i
        picks.append(pick)
        if (pick < 0).all():
            break
        best = nxt
    room, chosen = capacity, [0] * len(sizes)
    for pick in reversed(picks):
        if pick[room] >= 0:
            chosen[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), chosen


def solve_configurations(sizes: list[int], demand: list[int], capacity: int, max_rounds: int = 400) -> list[tuple[list[int], float]]:
    """The linear configuration programme: few configurations and how often to
    use each, covering the demand with the least sequences (Gilmore-Gomory column
    generation with a dense revised simplex; the sizes are few)."""
    m = len(sizes)
    columns = [[capacity // s if i == j else 0 for j in range(m)] for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / columns[i][i] for i in range(m)])
    x = inverse @ np.array(demand, float)
    for _ in range(max_rounds):
        value, column = _best_configuration(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ np.array(column, float)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        x = x - ratio[r] * d
        x[r] = ratio[r]
        inverse[r] /= d[r]
        for i in range(m):
            if i != r and d[i]:
                inverse[i] -= d[i] * inverse[r]
        columns[r] = column
    return [(c, float(k)) for c, k in zip(columns, x) if k > 1e-9]


def _grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Longest first, equal-cardinality groups of [length, count]."""
    total, out = sum(counts.values()), []
    bounds = sorted({round(total * (g + 1) / groups) for g in range(groups)} - {0})
    done, g = 0, []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            part = min(left, bounds[len(out)] - done)
            g.append([length, part])
            left -= part
            done += part
            if done == bounds[len(out)]:
                out.append(g)
                g = []
    return out


def _pack_large(counts: dict[int, int], capacity: int, groups: int) -> list[Run]:
    grouped = _grouped(counts, groups)
    merged: dict[int, list[list[int]]] = {}
    for g in grouped:  # groups that round up to the same length are one
        merged.setdefault(g[0][0], []).extend(g)
    sizes = list(merged)
    demand = [sum(k for _, k in merged[s]) for s in sizes]
    left, runs = list(demand), []
    for column, k in solve_configurations(sizes, demand, capacity):
        times = min([int(k + 1e-6), *(left[i] // c for i, c in enumerate(column) if c)])
        if times:
            runs.append((column, times))
            left = [a - c * times for a, c in zip(left, column)]
    rest = best_fit([], {s: k for s, k in zip(sizes, left) if k}, capacity)  # a few sequences
    index = {s: i for i, s in enumerate(sizes)}
    for run in rest:
        column = [0] * len(sizes)
        for s, k in run.items:
            column[index[s]] += k
        runs.append((column, run.times))
    out = []
    for column, times in runs:  # actual lengths take the places of the rounded ones
        while times:
            used = [(s, c) for s, c in zip(sizes, column) if c]
            step = min([times, *(merged[s][0][1] // c for s, c in used)]) or 1
            items: Counter[int] = Counter()
            for s, c in used:
                wanted, queue = c * step, merged[s]
                while wanted:
                    part = min(wanted, queue[0][1])
                    items[queue[0][0]] += part // step
                    queue[0][1] -= part
                    wanted -= part
                    if not queue[0][1]:
                        del queue[0]
            out.append(Run(step, sorted(items.items(), reverse=True), capacity - sum(x * k for x, k in items.items())))
            times -= step
    return out


def best_fit(runs: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    """Puts each length, longest first, into the fullest sequence that has room,
    else into a new one; like sequences are filled together."""
    by_room: dict[int, list[Run]] = {}
    for r in runs:
        by_room.setdefault(r.room, []).append(r)
    rooms = sorted(by_room)  # only those that some run has
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                run = by_room[rooms[at]].pop()
                if not by_room[run.room]:
                    del by_room[run.room], rooms[at]
            else:
                run = Run(left, [], capacity)
            each = run.room // length
            whole = min(run.times, left // each)
            put, k = (whole, each) if whole else (1, left)
            left -= put * k
            parts = [Run(put, [*run.items, (length, k)], run.room - k * length)]
            if run.times > put and run.items:
                parts.append(Run(run.times - put, run.items, run.room))
            for r in parts:
                if r.room not in by_room:
                    bisect.insort(rooms, r.room)
                by_room.setdefault(r.room, []).append(r)
    return [r for group in by_room.values() for r in group]


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> list[Run]:
    """Sequences for so many pieces of each length, as runs of like sequences."""
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    whole = [Run(counts[capacity], [(capacity, 1)], 0)] if counts.get(capacity) else []
    large = {x: k for x, k in counts.items() if capacity // SMALL_SHARE < x < capacity and k}
    small = {x: k for x, k in counts.items() if x <= capacity // SMALL_SHARE and k and x < capacity}
    tried = []
    for g in sorted({max(1, groups // 2), groups}):
        runs = best_fit(_pack_large(large, capacity, g) if large else [], small, capacity)
        for room in REOPEN:
            again: Counter[int] = Counter()
            for r in runs:
                if r.room * room >= capacity:
                    for length, k in r.items:
                        again[length] += k * r.times
            other = best_fit([r for r in runs if r.room * room < capacity], again, capacity)
            if sum(r.times for r in other) < sum(r.times for r in runs):
                runs = other
        tried.append(runs)
    return whole + min(tried, key=lambda runs: sum(r.times for r in runs))


def _pieces(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for i, j, ids, off in encoded_batches(bpe, batch.column(1)):
                rows: list[tuple[int, int, int, int, int]] = []
                for k in range(j - i):
                    own = np.append(ids[off[k] : off[k + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % capacity or capacity
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    rows += [(i + k, p, a, b - a, zlib.crc32(own[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                owner, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in rest)], names=["id", "piece", "start", "length", "crc"]
                )

    return run


def _placed(runs: list[Run]):
    """Slots of the plan as arrays, and a function that seats ranked pieces."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    cum: dict[int, int] = {}
    base = 0
    for r in runs:
        offset = 0
        for length, k in r.items:
            at = cum.get(length, 0)
            rows.append((length, at, base, offset, k, length))
            cum[length] = at + r.times * k
            offset += length * k
        base += r.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (table[:, 0] << 48) + table[:, 1]
        for f in frames:
            rank = f["rank"].to_numpy()
            row = table[np.searchsorted(key, (f["length"].to_numpy() << 48) + rank, "right") - 1]
            inside = rank - row[:, 1]
            f["sequence_id"] = row[:, 2] + inside // row[:, 4]
            f["offset"] = row[:, 3] + inside % row[:, 4] * row[:, 5]
            yield f[["id", "piece", "start", "length", "crc", "sequence_id", "offset"]]

    return run


def best_fit_packing(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS
) -> DataFrame:
    """Every text's ids and end_id, packed into few sequences of at most capacity.

    Returns one row per piece: id, piece, start (ids of its text before it),
    length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit
    integers), sequence_id and offset (its place there). Texts of more than
    capacity ids are cut into pieces of capacity ids, of which the first may be
    shorter; others stay whole. Null and empty texts have the end id alone. Rows
    with equal ids are packed as rows of their own. An empty table gives no rows.
    Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "id long, piece long, start long, length long, crc long"
    pieces = written(base.mapInArrow(_flat.trimmed(_pieces(vocabulary, capacity, end_id)), kind), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(counts, capacity, groups)

    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start", "crc"), F.lit(salts)))
    part = Window.partitionBy("length", "salt").orderBy("id", "piece", "crc")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(part) - 1).join(totals, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    seated = ranked.select("id", "piece", "start", "length", "crc", "rank").mapInPandas(_placed(runs), kind + ", sequence_id long, offset long")
    return seated.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
