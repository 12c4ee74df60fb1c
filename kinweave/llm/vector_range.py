"""Exact cosine near-duplicates of vectors as a metric range join.

Unit vectors at cosine c lie at distance sqrt(2 - 2c). Within each label, equal
vectors are one point. Pivots, drawn from the points by hash, part the space into
cells: a point lives in the cell of its nearest pivot. By the triangle inequality a
point x can have a neighbour within r in the cell of q only if its distance to the
plane between q and its own pivot p, (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)), is at most
r, and only if d(x,q) is at most the cell's radius plus r; x is copied to just those
cells, and cells join independently. A cell's residents and visitors are dealt into
blocks of BLOCK points, so each task compares at most BLOCK times BLOCK points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from kinweave.operators.components import connected_components
from kinweave.plans.storage import written

#: Points in one block, and pivots per (label, length): both bound what a task holds.
BLOCK = 2048
PIVOTS = 32


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _route(pivots: dict[tuple[int, int], tuple[np.ndarray, np.ndarray | None]], reach: float, home_only: bool):
    """Home cell of each point, or all the cells that it can have neighbours in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (space, dim), g in f.groupby(["space", "dim"], sort=False):
                p, radius = pivots[int(space), int(dim)]
                cos = np.clip(_matrix(g["unit"]) @ p.T, -1, 1)
                square = np.maximum(2 - 2 * cos, 0)
                home = square.argmin(axis=1)
                if home_only:
                    yield pd.DataFrame({"point": g["point"], "space": g["space"], "dim": g["dim"], "home": home, "far": np.sqrt(square[np.arange(len(g)), home])})
                    continue
                between = np.sqrt(np.maximum(2 - 2 * np.clip(p @ p.T, -1, 1), 1e-30))
                gap = (square - square[np.arange(len(g)), home][:, None]) / (2 * between[home])
                # room for rounding: squares are off by some 1e-13, which counts more the closer pivots are
                visit = (gap <= reach + 1e-6 + 1e-12 / between[home]) & (np.sqrt(square) <= radius[None, :] + reach + 1e-6)
                visit[np.arange(len(g)), home] = True
                row, cell = np.nonzero(visit)
                yield pd.DataFrame({"point": g["point"].to_numpy()[row], "space": g["space"].to_numpy()[row], "dim": g["dim"].to_numpy()[row], "cell": cell, "home": home[row], "unit": g["unit"].to_numpy()[row], "copies": g["copies"].to_numpy()[row]})

    return run


def _compare(least: float):
    """Residents of a block against visitors of a block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        here = group[group["resident"]].drop_duplicates("point")
        there = group[~group["resident"]].drop_duplicates("point")
        none = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="Int64"), "links": pd.Series([], dtype="int64")})
        if here.empty or there.empty:
            return none
        near = _matrix(here["unit"]) @ _matrix(there["unit"]).T >= least
        a, b = here["point"].to_numpy(), there["point"].to_numpy()
        near &= a[:, None] != b[None, :]
        counts = near @ there["copies"].to_numpy().astype(np.float64)
        forest, parent = [], {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(*np.nonzero(near)):
            x, y = root(int(a[i])), root(int(b[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((int(a[i]), int(b[j])))
        ends = pd.DataFrame(forest, columns=["a", "b"]).astype({"a": "int64", "b": "Int64"}).assign(links=0) if forest else none
        mine = pd.DataFrame({"a": a, "b": pd.array([pd.NA] * len(a), dtype="Int64"), "links": counts.astype(np.int64)})
        return pd.concat([mine[mine["links"] > 0], ends])

    return run


def vector_range_join(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Vectors of equal label with a cosine of at least `threshold` (double
    precision).

    Returns one row per input row: id, n_links (other vectors linked directly),
    component_id (smallest id reachable) and kept (id = component_id). Null labels,
    null or empty vectors, vectors with null or non-finite components and zero
    vectors link with nothing; vectors of different lengths never link. Rows with
    equal ids are vectors of their own. An empty table gives no rows. Other columns
    are ignored.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("space"), F.col(vector_col).cast(ArrayType(DoubleType())).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sound = F.col("space").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # by a power of two, which is exact, so that squares neither overflow nor vanish
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs)))))
    raw = raw.withColumn("v", F.when(sound & F.exists("v", lambda x: x != 0), F.transform("v", lambda x: x / scale)))
    typed = raw.withColumn("norm", F.when(sound, F.sqrt(norm))).withColumn("ok", F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False)))
    named = typed.withColumn("point", F.when(F.col("ok"), F.xxhash64("space", "v")))
    points = written(
        named.filter("ok").groupBy("point").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("space").alias("space"), F.first("v").alias("v"), F.first("norm").alias("norm"))
        .select("point", "id", "copies", "space", F.size("v").alias("dim"), F.transform("v", lambda x: x / F.col("norm")).alias("unit")), "points",
    )
    drawn = points.withColumn("rank", F.row_number().over(Window.partitionBy("space", "dim", F.pmod(F.xxhash64("point", F.lit(3)), F.lit(PIVOTS))).orderBy("point")))
    pivots: dict[tuple[int, int], list] = {}
    for r in drawn.filter("rank = 1").select("space", "dim", "unit").collect():  # PIVOTS a space
        pivots.setdefault((r["space"], r["dim"]), []).append(r["unit"])
    centres = {k: (np.array(sorted(v)), None) for k, v in pivots.items()}
    homes = points.select("point", "space", "dim", "unit").mapInPandas(_route(centres, reach, True), "point long, space long, dim int, home int, far double")
    radii = {k: np.full(len(v[0]), -1e9) for k, v in centres.items()}
    for r in homes.groupBy("space", "dim", "home").agg(F.max("far").alias("far")).collect():
        radii[r["space"], r["dim"]][r["home"]] = r["far"]
    full = {k: (v[0], radii[k]) for k, v in centres.items()}
    routed = points.select("point", "space", "dim", "unit", "copies").mapInPandas(_route(full, reach, False), "point long, space long, dim int, cell int, home int, unit array<double>, copies long")
    routed = written(routed, "cells")
    sizes = routed.groupBy("space", "dim", "cell").agg(F.ceil(F.sum(F.expr("cast(cell = home as int)")) / BLOCK).cast("int").alias("a_blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("b_blocks"))
    dealt = routed.join(sizes, ["space", "dim", "cell"])
    key = F.xxhash64("point", F.lit(9))
    columns = ["space", "dim", "cell", "p", "q", "resident", "point", "unit", "copies"]
    residents = dealt.filter("cell = home and a_blocks > 0").withColumn("p", F.pmod(key, F.col("a_blocks"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_blocks").cast("long") - 1))).withColumn("resident", F.lit(True)).select(columns)
    visitors = dealt.filter("a_blocks > 0").withColumn("q", F.pmod(key, F.col("b_blocks"))).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a_blocks").cast("long") - 1))).withColumn("resident", F.lit(False)).select(columns)
    found = written(residents.unionByName(visitors).groupBy("space", "dim", "cell", "p", "q").applyInPandas(_compare(threshold), "a long, b long, links long"), "links")

    links = found.filter("b is null").groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "point").join(points.select("point", "id"), "point")
    smallest = parts.groupBy("component").agg(F.min("id").alias("component_id"))
    per_point = points.select("point", "id", "copies").join(parts.join(smallest, "component").select("point", "component_id"), "point", "left").join(links, "point", "left")
    answer = per_point.select("point", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return named.select("id", "point").join(answer, "point", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("component_id", "id").eqNullSafe(F.col("id")).alias("kept"),
    )
