"""The reference-shaped queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import normalize as N
from kinweave.functions.similarity import jaccard, jaro_column, jaro_winkler_column
from kinweave.operators.blocking import STRATEGIES, block, block_counts, block_union
from kinweave.operators.survivorship import RULES, lineage_violations, survive
from kinweave.plans import evaluate, matching, overrides
from kinweave.plans.storage import written
from kinweave.sources import files
from kinweave.sources.roster import roster, truth

PRIORITY = ["purchase", "signup", "click"]
#: Sources in order of trust, for each golden field.
SOURCES = {
    "npi": ["clearinghouse", "payer_feed", "license_board", "site_scrape"],
    "given": ["license_board", "payer_feed", "clearinghouse", "site_scrape"],
    "family": ["license_board", "site_scrape", "payer_feed", "clearinghouse"],
    "credential": ["license_board", "payer_feed", "clearinghouse"],
    "street": ["payer_feed", "site_scrape", "clearinghouse"],
    "suite": ["payer_feed", "site_scrape", "clearinghouse"],
    "city": ["payer_feed", "site_scrape", "clearinghouse"],
    "state": ["license_board", "site_scrape", "clearinghouse", "payer_feed"],
    "zip": ["payer_feed", "site_scrape", "clearinghouse"],
    "phone": ["payer_feed", "site_scrape", "clearinghouse"],
    "specialty": ["license_board", "payer_feed", "clearinghouse", "site_scrape"],
    "network_status": ["payer_feed"],
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.normalized(roster(spark, sf_dir))


def vectors(r: DataFrame) -> DataFrame:
    return written(matching.compared(written(block_union(r), "candidates"), r), "vectors")


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scored pairs, normalised rows): both are read several times, so they are
    written tables."""
    r = written(rows(spark, sf_dir), "rows")
    v = vectors(r)
    return written(matching.scored(v, matching.fit_weights(v)), "scores"), r


@query
def norm_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = roster(spark, sf_dir)
    return r.select("source_system", "source_row_id", N.clean_npi(F.col("npi")).alias("npi"), N.clean_phone(F.col("phone")).alias("phone"), N.clean_zip(F.col("zip")).alias("zip"), N.clean_state(F.col("state")).alias("state"))


@query
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("source_system", "source_row_id", "given", "family")


@query
def norm_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("source_system", "source_row_id", F.array_join("tokens", "|").alias("tokens"), "suite")


@query
def key_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = rows(spark, sf_dir).select(F.col("family").alias("name")).filter("name is not null")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.upper(F.split("p_name", " ")[0]).alias("name"))
    return names.unionByName(parts).distinct().select("name", N.soundex(F.col("name")).alias("code"))


@query
def reach_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy("source_system").agg(F.count("*").alias("n"), *(F.count(c).alias(f"with_{c}") for c in ("npi", "zip", "family_soundex", "phone")))


@query
def true_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.true_pairs(rows(spark, sf_dir))


def _block(name: str) -> Query:
    return lambda spark, sf_dir: block(written(rows(spark, sf_dir), "rows"), STRATEGIES[name])


for _short, _name in (("npi", "npi_exact"), ("zip4", "zip_surname4"), ("sdx_state", "soundex_state"), ("phone", "phone_exact")):
    QUERIES[f"block_{_short}"] = _block(_name)


@query
def block_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_union(written(rows(spark, sf_dir), "rows"))


@query
def block_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, reduction and precision per strategy, from the sizes of blocks."""
    r = rows(spark, sf_dir)
    counted = block_counts(r)
    totals = evaluate.true_pairs(r).crossJoin(r.agg(F.count("*").alias("n")))
    c = counted.crossJoin(F.broadcast(totals))  # five rows by one
    possible = F.col("n") * (F.col("n") - 1) / 2
    return c.select(
        "strategy", "candidates", "true_found", F.round(F.try_divide("true_found", "true_pairs"), 4).alias("completeness"),
        F.round(1 - F.col("candidates") / possible, 6).alias("reduction"), F.round(F.coalesce(F.try_divide("true_found", "candidates"), F.lit(0.0)), 6).alias("precision"),
    )


@query
def block_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    side = lambda s: parts.select(F.col("p_partkey").alias(s), "p_brand", "p_type", F.substring("p_name", 1, 4).alias("name4"))
    return side("a").join(side("b"), ["p_brand", "p_type", "name4"]).filter("a < b").select("a", "b")


@query
def incremental_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small correction file against the base: the file is broadcast."""
    r = rows(spark, sf_dir)
    incoming = r.filter("source_system = 'clearinghouse' and npi is not null").orderBy("source_row_id").limit(50).select(F.col("source_row_id").alias("new_id"), "npi")
    base = r.filter("source_system != 'clearinghouse'").select("source_system", "source_row_id", "npi")
    return base.join(F.broadcast(incoming), "npi").select("new_id", "source_system", "source_row_id")


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = rows(spark, sf_dir).select("family", F.substring("family", 1, 1).alias("head")).filter("family is not null").distinct()
    return names.alias("x").join(names.alias("y"), "head").filter("x.family < y.family").select(F.col("x.family").alias("a"), F.col("y.family").alias("b"))


@query
def sim_jaro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(jaro_column("a", "b"), 6).alias("jaro"))


@query
def sim_jw_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    jw = _name_pairs(spark, sf_dir).withColumn("jw", jaro_winkler_column("a", "b"))
    return jw.select("a", "b", matching.graded_level(F.col("a"), F.col("b"), F.col("jw"), 0.95, 0.88).alias("level"))


@query
def sim_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().select("p_name", F.split("p_name", " ").alias("t"))
    pairs = names.select(F.col("p_name").alias("a"), F.col("t").alias("ta"), F.explode(F.array_distinct("t")).alias("w")).join(names.select(F.col("p_name").alias("b"), F.col("t").alias("tb"), F.explode(F.array_distinct("t")).alias("w")), "w").filter("a < b")
    return pairs.select("a", "b", F.round(jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard")).distinct()


@query
def compare_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(written(rows(spark, sf_dir), "rows")).select("a_sys", "a_id", "b_sys", "b_id", *matching.FIELDS)


@query
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(written(rows(spark, sf_dir), "rows")).groupBy(*matching.FIELDS).agg(F.count("*").alias("pairs"), F.count_if("is_match").alias("matches"))


@query
def fs_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fit_weights(vectors(written(rows(spark, sf_dir), "rows")))


@query
def fs_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)[0].select("a_sys", "a_id", "b_sys", "b_id", "score", "is_match")


@query
def sweep_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep(*scored(spark, sf_dir))


@query
def cost_optima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cost_optima(evaluate.sweep(*scored(spark, sf_dir)))


@query
def review_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.review_band(*scored(spark, sf_dir))


@query
def cost_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cost_penalty(written(evaluate.sweep(*scored(spark, sf_dir)), "curve"))


@query
def recall_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_ceiling(*scored(spark, sf_dir))


@query
def sweep_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.curve_faults(evaluate.sweep(*scored(spark, sf_dir)))


@query
def damage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.damage_sweep(*scored(spark, sf_dir))


@query
def norm_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roster(spark, sf_dir).select("source_system", "source_row_id", N.persons(F.col("name_raw")).alias("p"))
    return p.select("source_system", "source_row_id", F.size("p").alias("persons"), F.array_join("p", "|").alias("names"))


@query
def load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roster as CSV, loaded again by schema, guarded, and held against its manifest."""
    return files.load_and_verify(roster(spark, sf_dir))


@query
def cc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overrides.clusters(*scored(spark, sf_dir), 2).select("sys", "id", "component")


@query
def cc_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.damage(overrides.clusters(*scored(spark, sf_dir), 2))


@query
def multi_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    false = scored(spark, sf_dir)[0].filter((F.col("score") >= overrides.ACCEPT) & ~F.col("is_match"))
    return false.agg(F.count("*").alias("false_accepts"), F.count_if("multi").alias("with_multi"), F.round(F.coalesce(F.try_divide(F.count_if("multi"), F.count("*")), F.lit(0.0)), 6).alias("share"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.floor("value") % 7
    return e.select("user_id", F.when(v != 0, v).alias("value"), F.col("event_type").alias("source"), F.col("event_id").alias("key"), F.col("ts").alias("seen"))


def _rule(name: str) -> Query:
    return lambda spark, sf_dir: survive(_events(spark, sf_dir), ["user_id"], PRIORITY).select("user_id", F.col(f"{name}_value").alias("value"), F.col(f"{name}_key").alias("event_id"))


for _name in ("first", "recent", "majority", "priority"):
    QUERIES[f"surv_{_name}"] = _rule(_name)


def golden_rows(s: DataFrame, r: DataFrame) -> DataFrame:
    """Long form: cluster, field, value, source, key, seen of unwelded clusters."""
    c = written(overrides.clusters(s, r, 2), "clusters")
    sound = c.groupBy("component").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity")).filter("n = 1")
    kept = c.join(sound.select("component", "entity"), "component").select("component", "entity", F.col("sys").alias("source_system"), F.col("id").alias("source_row_id"))
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in SOURCES)))
    street = F.when(F.size("tokens") > 0, F.array_join("tokens", " "))
    joined = kept.join(r.drop("entity_id").withColumn("street", street), ["source_system", "source_row_id"])
    return joined.select("component", "entity", F.col("source_system").alias("source"), F.col("source_row_id").alias("key"), F.col("observed_at").alias("seen"), long.alias("x")).select("component", "entity", "x.*", "source", F.col("key").cast("long").alias("key"), "seen")


@query
def surv_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden values with the source row and the rule that each came from."""
    g = survive(golden_rows(*scored(spark, sf_dir)), ["component", "field"], SOURCES)
    return g.select("component", "field", F.col("priority_value").alias("value"), F.col("priority_source").alias("source"), F.col("priority_key").alias("key"), F.lit("source_priority").alias("rule"))


@query
def surv_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lineage sample for readers: 100 golden values beside the raw row they name."""
    g = surv_golden(spark, sf_dir).orderBy("component", "field").limit(100)
    raw = roster(spark, sf_dir).select(F.col("source_system").alias("source"), F.col("source_row_id").cast("long").alias("key"), "name_raw", F.col("street").alias("street_raw"), "observed_at")
    return raw.join(F.broadcast(g), ["source", "key"])


@query
def surv_lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No golden value may differ from the row it names; swapped values must."""
    e = _events(spark, sf_dir)
    g = survive(e, ["user_id"], PRIORITY)
    wrong = g.withColumn("priority_value", F.col("priority_value") % 6 + 1)
    checks = (lineage_violations(g, e, ["user_id"], "priority_value", "priority_key").agg(F.count("*").alias("violations")), lineage_violations(wrong, e, ["user_id"], "priority_value", "priority_key").agg(F.count("*").alias("control")))
    return checks[0].crossJoin(checks[1])


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of sound clusters whose golden value is the truth, nulls included, by field
    and rule: of all, and of entities with one site (`_single`)."""
    s, r = scored(spark, sf_dir)
    long = written(golden_rows(s, r), "long")
    g = survive(long, ["component", "field"], SOURCES)
    true = truth(spark, sf_dir).select("entity", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("truth")) for f in SOURCES))).alias("x")).select("entity", "x.*")
    sites = two_site(spark, sf_dir).select(F.col("entity_id").alias("entity"), F.lit(False).alias("one"))
    met = long.select("component", "entity").distinct().join(true, "entity").join(g, ["component", "field"], "left").join(sites, "entity", "left").withColumn("one", F.coalesce("one", F.lit(True)))
    hit = lambda n: F.col(f"{n}_value").eqNullSafe(F.col("truth")).cast("int")
    return met.groupBy("field").agg(
        *(F.round(F.avg(hit(n)), 6).alias(n) for n in RULES), *(F.round(F.avg(F.when(F.col("one"), hit(n))), 6).alias(f"{n}_single") for n in RULES),
        F.count("*").alias("clusters"), F.count_if("one").alias("clusters_single"),
    )


@query
def surv_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accuracy(), and the mean over the fields."""
    a = written(accuracy(spark, sf_dir), "accuracy")  # a row a field
    shares = [c for c in a.columns if c not in ("field", "clusters", "clusters_single")]
    mean = a.agg(*(F.round(F.avg(c), 6).alias(c) for c in shares), F.max("clusters").alias("clusters"), F.max("clusters_single").alias("clusters_single"))
    return a.unionByName(mean.withColumn("field", F.lit("(mean)")))


@query
def surv_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each field the most accurate rule, the first by name of equals."""
    a = accuracy(spark, sf_dir)
    told = a.select("field", F.explode(F.array(*(F.struct(F.col(n).alias("accuracy"), F.lit(n).alias("rule")) for n in sorted(RULES)))).alias("x")).select("field", "x.*")
    return told.groupBy("field").agg(F.max("accuracy").alias("accuracy"), F.max_by(F.struct("rule"), F.struct("accuracy", -F.ascii("rule"), -F.ascii(F.substring("rule", 2, 1)))).alias("r")).select("field", "accuracy", "r.rule")


@query
def two_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy("source_system", "entity_id").count().filter("count > 1").select("entity_id").distinct()


@query
def orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("customers"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s, r = scored(spark, sf_dir)
    return s, r, written(overrides.clusters(s, r, 1), "run1"), written(overrides.clusters(s, r, 2), "run2")


@query
def ovr_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, first, _ = _runs(spark, sf_dir)
    return overrides.build(s, first)


@query
def ovr_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, first, second = _runs(spark, sf_dir)
    return overrides.replay(overrides.build(s, first), second)


@query
def ovr_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, first, second = _runs(spark, sf_dir)
    return overrides.stability(first, second)


@query
def ovr_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r, first, _ = _runs(spark, sf_dir)
    return overrides.stale_pins(overrides.build(s, first), r)
