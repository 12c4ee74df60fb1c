"""One value per cluster from several rows, with the row it came from.

Input: cluster, value, source, key, seen. All four rules are one aggregation, with
partial aggregates on the map side; null values never win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


RULES = ("first", "recent", "majority", "priority")


def survive(rows: DataFrame, cluster: list[str], priority: list[str] | dict[str, list[str]]) -> DataFrame:
    """priority: one ranked list of sources, or one for each value of the column `field`.

    cluster, then value, source and key under first_non_null, most_recent, majority_vote
    and source_priority. Ties: the earliest (source, key); the latest (seen, source,
    key); the most recent row of all top values; the best rank, then the latest
    seen, then the lowest key - if no ranked source has a value, the most recent."""
    told = rows.filter("value is not null")
    by_field = priority if isinstance(priority, dict) else {None: priority}
    asked = [((F.col("source") == s) if f is None else (F.col("field") == f) & (F.col("source") == s), i) for f, sources in by_field.items() for i, s in enumerate(sources)]
    rank = F.coalesce(*(F.when(c, i) for c, i in asked))
    votes = told.groupBy(*cluster, "value").agg(F.count("*").alias("votes"), F.max(F.struct("seen", "source", "key")).alias("last"))
    vote = votes.groupBy(*cluster).agg(F.max(F.struct("votes", "last", "value")).alias("v")).select(*cluster, F.col("v.value").alias("majority_value"), F.col("v.last.source").alias("majority_source"), F.col("v.last.key").alias("majority_key"))
    row = F.struct("value", "source", "key")
    recency = F.struct("seen", "source", "key")
    best = told.withColumn("rank", rank).groupBy(*cluster).agg(
        F.min_by(row, F.struct("source", "key")).alias("first"), F.max_by(row, recency).alias("recent"),
        F.max_by(row, F.when(F.col("rank").isNotNull(), F.struct(-F.col("rank"), F.col("seen"), -F.col("key")))).alias("ranked"),
    )
    out = best.withColumn("priority", F.coalesce("ranked", "recent")).join(vote, cluster)
    return out.select(*cluster, *(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("first", "recent", "priority") for c in ("value", "source", "key")), "majority_value", "majority_source", "majority_key")


def lineage_violations(golden: DataFrame, rows: DataFrame, cluster: list[str], value: str, key: str) -> DataFrame:
    """Golden values that the row they name does not offer."""
    named = golden.select(*cluster, F.col(value).alias("golden"), F.col(key).alias("key"))
    return named.join(rows.select(*cluster, "key", "value"), [*cluster, "key"], "left").filter(~F.col("golden").eqNullSafe(F.col("value")))
