"""Normalise, compare and score: probabilistic record linkage as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import normalize as N
from kinweave.functions.similarity import jaccard, jaro_winkler_column
from kinweave.plans.storage import written

FIELDS = ["npi", "given", "family", "street", "phone", "zip", "state", "specialty"]
LEVELS = ["agree", "partial", "disagree", "missing"]
KEY = ["source_system", "source_row_id"]


def normalized(rows: DataFrame) -> DataFrame:
    """Typed keys of each source row; multi-person rows give their first person."""
    family = N.family_name(F.col("source_system"), F.col("name_raw"))
    return rows.select(
        *KEY, "entity_id", "ingest_batch", "observed_at", "multi", "moved", "network_status", N.credential(F.col("name_raw")).alias("credential"), N.clean_npi(F.col("npi")).alias("npi"), N.given_name(F.col("source_system"), F.col("name_raw")).alias("given"),
        family.alias("family"), F.substring(family, 1, 4).alias("surname4"), N.soundex(family).alias("family_soundex"), F.coalesce(N.street_tokens(F.col("street")), F.array().cast("array<string>")).alias("tokens"),
        N.clean_suite(F.col("suite"), F.col("street")).alias("suite"), F.upper(F.trim("city")).alias("city"), N.clean_state(F.col("state")).alias("state"),
        N.clean_zip(F.col("zip")).alias("zip"), N.clean_phone(F.col("phone")).alias("phone"), "specialty",
    )


def exact_level(a: Column, b: Column) -> Column:
    """A missing value is a level of its own, never a disagreement."""
    return F.when(a.isNull() | b.isNull(), "missing").when(a == b, "agree").otherwise("disagree")


def graded_level(a: Column, b: Column, likeness: Column, agree: float, partial: float) -> Column:
    return F.when(a.isNull() | b.isNull(), "missing").when(likeness >= agree, "agree").when(likeness >= partial, "partial").otherwise("disagree")


#: Distinct string pairs up to this number are sent to every task, else joined.
BROADCAST_PAIRS = 200_000


def _with_likenesses(pairs: DataFrame, wanted: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Jaro-Winkler of several string pairs a row: each distinct unequal pair is worked
    out once, in a table that is broadcast if it is counted to be small."""
    met = F.explode(F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in wanted.values()))).alias("p")
    distinct = pairs.select(met).select("p.*").filter("x is not null and y is not null and x != y").distinct()
    table = written(distinct.withColumn("jw", jaro_winkler_column("x", "y")), "likeness")
    small = table.count() <= BROADCAST_PAIRS
    for name, (a, b) in wanted.items():
        own = table.select(F.col("x").alias(f"_x_{name}"), F.col("y").alias(f"_y_{name}"), F.col("jw").alias(name))
        keyed = pairs.withColumn(f"_x_{name}", a).withColumn(f"_y_{name}", b)
        pairs = keyed.join(F.broadcast(own) if small else own, [f"_x_{name}", f"_y_{name}"], "left").fillna(1.0, [name]).drop(f"_x_{name}", f"_y_{name}")
    return pairs


def compared(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs with the level of each field, is_match and the lower entity."""
    columns = ["npi", "given", "family", "tokens", "phone", "zip", "state", "specialty", "entity_id", "multi", "ingest_batch"]
    side = lambda s: rows.select(F.col("source_system").alias(f"{s}_sys"), F.col("source_row_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    both = pairs.join(side("a"), ["a_sys", "a_id"]).join(side("b"), ["b_sys", "b_id"])
    names = {"jw_raw": (F.col("a_given"), F.col("b_given")), "jw_folded": (N.canonical_given(F.col("a_given")), N.canonical_given(F.col("b_given"))), "jw_family": (F.col("a_family"), F.col("b_family"))}
    both = _with_likenesses(both, names)
    tokens = jaccard(F.col("a_tokens"), F.col("b_tokens"))
    pair = lambda f: (F.col(f"a_{f}"), F.col(f"b_{f}"))
    levels = {
        "given": graded_level(*pair("given"), F.greatest("jw_raw", "jw_folded"), 0.95, 0.85),
        "family": graded_level(*pair("family"), F.col("jw_family"), 0.95, 0.88),
        "street": F.when((F.size("a_tokens") == 0) | (F.size("b_tokens") == 0), "missing").when(tokens >= 0.85, "agree").when(tokens >= 0.5, "partial").otherwise("disagree"),
    }
    return both.select(
        "a_sys", "a_id", "b_sys", "b_id", *(levels.get(f, exact_level(*pair(f)) if f not in levels else None).alias(f) for f in FIELDS),
        (F.col("a_entity_id") == F.col("b_entity_id")).alias("is_match"), F.least("a_entity_id", "b_entity_id").alias("entity"), (F.col("a_multi") | F.col("b_multi")).alias("multi"),
        F.greatest("a_ingest_batch", "b_ingest_batch").alias("batch"),
    )


def fit_weights(vectors: DataFrame) -> DataFrame:
    """(field, level, m, u, weight): smoothed log2 odds on the odd half, for all 32
    cells; weights to four places."""
    told = vectors.filter("entity % 2 = 1")
    long = told.select("is_match", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("level")) for f in FIELDS))).alias("x")).select("is_match", "x.*")
    counts = long.groupBy("field", "level").agg(F.count_if("is_match").alias("m"), F.count_if(~F.col("is_match")).alias("u"))
    totals = told.agg(F.count_if("is_match").alias("nm"), F.count_if(~F.col("is_match")).alias("nu"))
    grid = vectors.sparkSession.createDataFrame([(f, v) for f in FIELDS for v in LEVELS], "field string, level string")
    full = grid.join(counts, ["field", "level"], "left").fillna(0, ["m", "u"]).crossJoin(F.broadcast(totals))  # 32 rows by one
    odds = ((F.col("m") + 0.5) / (F.col("nm") + 2)) / ((F.col("u") + 0.5) / (F.col("nu") + 2))
    return full.select("field", "level", "m", "u", F.round(F.log2(odds), 4).alias("weight"))


def scored(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """Pairs with the sum of their fields' weights, worked out once per pattern."""
    patterns = vectors.select(*FIELDS).distinct()
    long = patterns.select(*FIELDS, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("level")) for f in FIELDS))).alias("x"))
    sums = long.select(*FIELDS, "x.*").join(F.broadcast(weights), ["field", "level"]).groupBy(*FIELDS).agg(F.round(F.sum("weight"), 4).alias("score"))
    return vectors.join(F.broadcast(sums), FIELDS)  # at most 4 ** 8 patterns
