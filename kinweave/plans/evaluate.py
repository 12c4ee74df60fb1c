"""Threshold sweep, pricing and review bands on the even half."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components

RATIOS = [1, 3, 10, 30]
DAMAGE_AT = [2.0, 5.0, 8.0, 11.0, 14.0]
WIDTHS = [0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4]


def true_pairs(rows: DataFrame) -> DataFrame:
    """One row: pairs of rows of one entity, whether blocking found them or not."""
    return rows.groupBy("entity_id").count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).cast("long").alias("true_pairs"))


def histogram(scores: DataFrame) -> DataFrame:
    """Even-half pairs by score: a few thousand rows, whatever the input."""
    return scores.filter("entity % 2 = 0").groupBy("score").agg(F.count_if("is_match").alias("t"), F.count_if(~F.col("is_match")).alias("f"))


def sweep(scores: DataFrame, rows: DataFrame, steps: int = 200) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall and f1 on an even grid; a pair is
    accepted at its score and above."""
    hist = histogram(scores)
    ends = hist.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    grid = scores.sparkSession.range(steps + 1).crossJoin(F.broadcast(ends)).select("id", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("id") / steps).alias("threshold"))
    total = true_pairs(rows.filter("entity_id % 2 = 0"))
    at = grid.join(F.broadcast(hist), hist.score >= grid.threshold, "left").groupBy("id", "threshold").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tp"), F.coalesce(F.sum("f"), F.lit(0)).alias("fp"))
    c = at.crossJoin(F.broadcast(total)).withColumn("fn", F.col("true_pairs") - F.col("tp"))
    p = F.when(F.col("tp") + F.col("fp") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("true_pairs")), F.lit(0.0))
    return c.select(F.round("threshold", 3).alias("threshold"), "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def cost_optima(curve: DataFrame) -> DataFrame:
    """For each price of a false match in misses: the cheapest threshold, the lowest
    of equals, and its cost."""
    ratios = curve.sparkSession.createDataFrame([(r,) for r in RATIOS], "ratio long")
    priced = curve.crossJoin(F.broadcast(ratios)).withColumn("cost", F.col("ratio") * F.col("fp") + F.col("fn"))
    best = priced.groupBy("ratio").agg(F.min(F.struct("cost", "threshold")).alias("b"))
    return best.select("ratio", "b.threshold", "b.cost")


def review_band(scores: DataFrame, rows: DataFrame, ratio: int = 10) -> DataFrame:
    """width, queue and cost when pairs in a band about the optimum go to review."""
    hist = histogram(scores)
    centre = cost_optima(sweep(scores, rows)).filter(F.col("ratio") == ratio).select(F.col("threshold").alias("mid"))
    span = hist.agg((F.max("score") - F.min("score")).alias("span"))
    widths = scores.sparkSession.createDataFrame([(w,) for w in WIDTHS], "width double")
    bands = widths.crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(span)).select("width", (F.col("mid") - F.col("width") * F.col("span") / 2).alias("lower"), (F.col("mid") + F.col("width") * F.col("span") / 2).alias("upper"))
    total = true_pairs(rows.filter("entity_id % 2 = 0"))
    inside, above = (F.col("score") >= F.col("lower")) & (F.col("score") < F.col("upper")), F.col("score") >= F.col("upper")
    cells = hist.crossJoin(F.broadcast(bands)).crossJoin(F.broadcast(total))  # eight bands
    s = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    out = cells.groupBy("width").agg((s(inside, "t") + s(inside, "f")).cast("long").alias("queue"), (F.lit(ratio) * s(above, "f") + F.first("true_pairs") - s(above | inside, "t")).cast("long").alias("cost"))
    one = cost_optima(sweep(scores, rows)).filter(F.col("ratio") == ratio).select(F.col("cost").alias("single"))
    providers = rows.filter("entity_id % 2 = 0").agg(F.count_distinct("entity_id").alias("providers"))
    priced = out.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(providers)).withColumn("removed", F.col("single") - F.col("cost"))  # eight rows by one
    line = Window.orderBy("width")  # eight rows
    more, gain = F.col("queue") - F.lag("queue").over(line), F.col("removed") - F.lag("removed").over(line)
    return priced.select(
        "width", "queue", "cost", "removed", F.round(F.col("queue") * 10000.0 / F.col("providers"), 1).alias("per_10000"),
        F.round(F.coalesce(F.try_divide("removed", "queue"), F.lit(0.0)), 4).alias("break_even"), F.when(F.lag("queue").over(line).isNotNull(), F.round(F.coalesce(F.try_divide(gain, more), F.lit(0.0)), 4)).alias("marginal"),
    )


def cost_penalty(curve: DataFrame) -> DataFrame:
    """For each price what the threshold of the best F1 (the lowest of equals) costs
    more than the cheapest one, and how far they lie apart."""
    best = curve.agg(F.max_by(F.struct("threshold", "fp", "fn", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select(F.col("b.threshold").alias("f1_threshold"), "b.fp", "b.fn", "b.f1")
    priced = cost_optima(curve).crossJoin(F.broadcast(best)).withColumn("f1_cost", F.col("ratio") * F.col("fp") + F.col("fn"))  # four rows by one
    return priced.select("ratio", "threshold", "cost", "f1_threshold", "f1", "f1_cost", (F.col("f1_cost") - F.col("cost")).alias("extra"), F.round(F.col("threshold") - F.col("f1_threshold"), 3).alias("moved"))


def recall_ceiling(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the even half's true pairs those that blocking found: no threshold gets more."""
    found = scores.filter("entity % 2 = 0").agg(F.count("*").alias("scored"), F.count_if("is_match").alias("found"))
    both = found.crossJoin(F.broadcast(true_pairs(rows.filter("entity_id % 2 = 0"))))
    return both.select("scored", "found", "true_pairs", F.round(F.coalesce(F.try_divide("found", "true_pairs"), F.lit(0.0)), 6).alias("ceiling"))


def curve_faults(curve: DataFrame) -> DataFrame:
    """One row: thresholds at which recall rises, and whether all accept alike."""
    steps = curve.withColumn("before", F.lag("tp").over(Window.orderBy("threshold", F.desc("tp"))))  # a grid of a few hundred rows
    return steps.agg(F.count_if(F.col("tp") > F.col("before")).alias("rises"), (F.count_distinct(F.col("tp") + F.col("fp")) <= 1).cast("int").alias("degenerate"))


def check_curve(curve: DataFrame) -> None:
    """Raises on a curve that cannot be a sweep's, before anything is read off it."""
    found = curve_faults(curve).first()
    if found["rises"]:
        raise ValueError(f"recall rises with the threshold at {found['rises']} places")
    if found["degenerate"]:
        raise ValueError("every threshold accepts the same pairs: the grid misses the scores")


def damage_sweep(scores: DataFrame, rows: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """What the closure does at each threshold, over the even half: all thresholds are
    one graph, whose nodes carry their threshold."""
    grid = F.array(*(F.lit(float(t)) for t in thresholds or DAMAGE_AT))
    told = scores.filter("entity % 2 = 0").withColumn("threshold", F.explode(F.filter(grid, lambda t: F.col("score") >= t)))
    pairs = told.groupBy("threshold").agg(F.count("*").alias("accepted"), F.count_if("is_match").alias("accepted_true"), F.count_if(~F.col("is_match")).alias("accepted_false"))
    name = lambda sys, key: F.concat_ws("|", F.col("threshold").cast("string"), F.col(sys), F.col(key).cast("string"))
    stars = connected_components(told.select(name("a_sys", "a_id").alias("a"), name("b_sys", "b_id").alias("b")))
    nodes = rows.filter("entity_id % 2 = 0").select("source_system", "source_row_id", "entity_id", F.explode(grid).alias("threshold")).withColumn("node", name("source_system", "source_row_id"))
    members = nodes.join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    clusters = members.groupBy("threshold", "component").agg(F.count_distinct("entity_id").alias("n"), F.count("*").alias("size"))
    shape = clusters.groupBy("threshold").agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("welded"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("size"))), F.lit(0)).alias("rows_welded"), F.max("n").alias("worst"))
    held = members.join(clusters.select("threshold", "component", "n"), ["threshold", "component"]).groupBy("threshold", "entity_id").agg(F.count_distinct("component").alias("k"), F.max((F.col("n") > 1).cast("int")).alias("w"))
    spread = held.groupBy("threshold").agg(F.count("*").alias("providers"), F.sum("w").alias("providers_welded"), F.count_if(F.col("k") > 1).alias("split"))
    joined = shape.join(spread, "threshold").join(pairs, "threshold", "left").fillna(0, ["accepted", "accepted_true", "accepted_false"])
    return joined.withColumn("false_share", F.round(F.coalesce(F.try_divide("accepted_false", "accepted"), F.lit(0.0)), 6))


def damage(members: DataFrame) -> DataFrame:
    """Of (component, entity_id): clusters that weld entities, entities split over
    clusters, and the most entities in one cluster."""
    by_cluster = members.groupBy("component").agg(F.count_distinct("entity_id").alias("n"))
    by_entity = members.groupBy("entity_id").agg(F.count_distinct("component").alias("n"))
    return by_cluster.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("welded"), F.max("n").alias("worst")).crossJoin(by_entity.agg(F.count_if(F.col("n") > 1).alias("fragmented")))
