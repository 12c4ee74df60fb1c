"""Human decisions and what a second ingest does to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components

ACCEPT = 8.0
KEYS = ["sys", "id"]


def clusters(scores: DataFrame, rows: DataFrame, batch: int, threshold: float = ACCEPT) -> DataFrame:
    """(sys, id, component, cluster_id) of all rows up to a batch; rows without an
    accepted pair are clusters of one. cluster_id ranks the clusters' smallest keys."""
    name = lambda s: F.format_string("%s/%012d", f"{s}_sys", f"{s}_id")
    edges = scores.filter((F.col("score") >= threshold) & (F.col("batch") <= batch)).select(name("a").alias("a"), name("b").alias("b"))
    nodes = rows.filter(F.col("ingest_batch") <= batch).select(F.col("source_system").alias("sys"), F.col("source_row_id").alias("id"), "entity_id", "ingest_batch", "moved", F.format_string("%s/%012d", "source_system", "source_row_id").alias("node"))
    joined = nodes.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return joined.join(_ranked(joined.select("component").distinct(), "component", "cluster_id"), "component").select(*KEYS, "entity_id", "moved", "component", "cluster_id")


def _ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """Dense ranks of distinct values without one task for all: ranks within values
    that differ in the last four digits only, so of 10,000 at most, plus running
    totals of these ranges."""
    part = F.expr(f"substring({column}, 1, length({column}) - 4)")
    within = df.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(column)))
    totals = within.groupBy("_p").count().withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(totals.select("_p", "_b")), "_p").select(column, (F.col("_r") + F.col("_b")).cast("long").alias(name))


def build(scores: DataFrame, first: DataFrame, limit: int = 200, pins: int = 100) -> DataFrame:
    """Splits of accepted false pairs, merges of rejected true ones, pins of
    movers' clearing-house rows: the first by key of each kind, with a's cluster id then."""
    known = scores.filter("batch = 1")
    order = ["a_sys", "a_id", "b_sys", "b_id"]
    pick = lambda df, kind, n: df.orderBy(*order).limit(n).select(F.lit(kind).alias("kind"), *order)
    splits = pick(known.filter((F.col("score") >= ACCEPT) & ~F.col("is_match")), "split", limit)
    merges = pick(known.filter((F.col("score") < ACCEPT) & F.col("is_match")), "merge", limit)
    moved = first.filter("sys = 'clearinghouse' and moved").select(F.col("sys").alias("a_sys"), F.col("id").alias("a_id"), F.lit(None).cast("string").alias("b_sys"), F.lit(None).cast("int").alias("b_id"))
    made = splits.unionByName(merges).unionByName(pick(moved, "pin", pins))
    return made.join(first.select(F.col("sys").alias("a_sys"), F.col("id").alias("a_id"), F.col("cluster_id").alias("created_id")), ["a_sys", "a_id"]).select("kind", *order, "created_id")


def replay(made: DataFrame, second: DataFrame) -> DataFrame:
    """Per kind, what becomes of decisions kept by cluster id: still on the cluster
    of their row, on another (unrelated: one without any row of the same entity),
    or on none; by natural key they all stay."""
    now = second.select(F.col("sys").alias("a_sys"), F.col("id").alias("a_id"), F.col("cluster_id").alias("now_id"))
    ids = second.select(F.col("cluster_id").alias("created_id")).distinct().withColumn("exists", F.lit(True))
    entity = second.select(F.col("sys").alias("a_sys"), F.col("id").alias("a_id"), "entity_id")
    holds = second.select(F.col("cluster_id").alias("created_id"), "entity_id").distinct().withColumn("related", F.lit(True))
    seen = made.join(now, ["a_sys", "a_id"], "left").join(ids, "created_id", "left").join(entity, ["a_sys", "a_id"], "left").join(holds, ["created_id", "entity_id"], "left")
    kept = F.col("now_id").eqNullSafe(F.col("created_id"))
    return seen.groupBy("kind").agg(F.count_if(kept).alias("retained"), F.count_if(~kept & F.col("exists").isNotNull()).alias("misapplied"), F.count_if(~kept & F.col("exists").isNull()).alias("lost"), F.count_if(~kept & F.col("exists").isNotNull() & ~F.coalesce(F.col("related"), F.lit(False))).alias("unrelated"), F.count_if(F.col("now_id").isNotNull()).alias("kept_by_key"))


def stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """Clusters of the first run: with other members in the second, without a cluster
    of the same smallest key there, or with another id."""
    mark = lambda df, n: df.groupBy("cluster_id").agg(F.min("component").alias("name"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "sys", "id"))), "|"), 256).alias("members")).select("name", F.col("cluster_id").alias(f"{n}_id"), F.col("members").alias(f"{n}_members"))
    both = mark(first, "old").join(mark(second, "new"), "name", "left")
    same = F.col("old_members").eqNullSafe(F.col("new_members"))
    return both.agg(F.count("*").alias("clusters"), F.count_if(~same & F.col("new_members").isNotNull()).alias("different"), F.count_if(F.col("new_members").isNull()).alias("absent"), F.count_if(~F.col("old_id").eqNullSafe(F.col("new_id"))).alias("renumbered"))


def stale_pins(made: DataFrame, rows: DataFrame) -> DataFrame:
    """Pins whose entity has a clearing-house row in a later batch."""
    entity = rows.select(F.col("source_system").alias("a_sys"), F.col("source_row_id").alias("a_id"), "entity_id")
    later = rows.filter("source_system = 'clearinghouse' and ingest_batch > 1").select("entity_id").distinct()
    return made.filter("kind = 'pin'").join(entity, ["a_sys", "a_id"]).join(later, "entity_id", "left_semi").select("a_sys", "a_id")
