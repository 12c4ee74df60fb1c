"""Document fingerprints by consistent weighted sampling, in DataFrame functions
alone.

Each term of a text has its count as weight. For sample k, a term draws from its own
hash r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1); with t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1), the term of least a gives the sample (term, t). Two texts
give equal samples with a probability equal to their generalised Jaccard similarity,
the sum of smaller weights over the sum of larger ones (Ioffe, 2010).

A sample is one long: ln a, scaled to an integer, above 20 bits of the hash of
(term, t); so all samples of a text are plain minima. A fingerprint shows 16 of these
bits a sample in hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.storage import Written, release

SAMPLES = 32
_CUTS = 4
_STEPS = 256  # parts of the rows of an id that many rows share
_TOGETHER = 2  # samples drawn in a row


def _unit(h: Column, shift: int) -> Column:
    """21 bits of a hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0x1FFFFF)) + 0.5) / F.lit(float(1 << 21))


def sample(term: Column, ln_weight: Column, k: Column) -> Column:
    """The long by which a term of that weight enters sample k (an int column)."""
    h, g = F.xxhash64(term, 2 * k), F.xxhash64(term, 2 * k + 1)
    r = -F.ln(_unit(h, 0) * _unit(h, 21))
    c = F.ln(-F.ln(_unit(g, 0) * _unit(g, 21)))
    b = F.when(k % 2 == 1, _unit(h, 42)).otherwise(_unit(g, 42))
    t = F.floor(ln_weight / r + b)
    rank = F.floor((c - r * (t - b + 1) + 4096.0) * float(1 << 30))
    return F.shiftleft(rank, 20).bitwiseOR(F.xxhash64(term, t, k).bitwiseAND(F.lit(0xFFFFF)))


def terms(text: Column) -> Column:
    """Words of a text in lower case, parted by white space; '' stands between."""
    return F.split(F.lower(text), r"\s+")


def _shown(samples: Column) -> Column:
    """Hex of the samples in the order of k; '' where there are none."""
    return F.array_join(F.transform(samples, lambda m: F.lpad(F.lower(F.hex(m.bitwiseAND(F.lit(0xFFFF)))), 4, "0")), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; fingerprints of term-free texts are '' and alike."""
    same = sum(((F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples)), F.lit(0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / float(samples))


def _above(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are at most x, in two steps of about the
    square root of their number."""
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    met = lambda c: F.size(F.filter(c, lambda b: b <= x))
    coarse = bounds[width - 1 :: width]
    passed = (met(F.array(*map(F.lit, coarse))) if coarse else F.lit(0)) * width
    return passed + met(F.slice(F.array(*map(F.lit, bounds)), passed + 1, F.lit(width)))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n / 2) code
    points replaced by the first as many (or all) of the next text by id (after the
    last: the first).

    Returns one row per input row: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts count as empty; texts
    without terms have the fingerprint ''. Null ids come first; rows with equal ids
    follow one another by a hash of their text. A single text is its own next. An
    empty table gives no rows. Other columns are ignored.

    The order is cut into ranges at quantiles of the id, and within an id that many
    rows share at equal steps of the hash; the first text of a range is sent to the
    range before it as well, so that no task sees more than its range. The texts are
    exchanged twice, one time after the other: for the digests and for the samples.
    """
    spark = docs.sparkSession
    ranges = _CUTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    total, cuts = base.agg(F.count("*"), F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()
    if not total:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_chars"), *(F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"))
    heavy = [r["id"] for r in base.groupBy("id").count().filter(F.col("count") > max(total // ranges, 1)).select("id").collect()]  # fewer than `ranges`
    alone = sorted(x for x in heavy if x is not None)
    bounds = sorted({*(cuts or []), *alone, *(x + 1 for x in alone if x + 1 < 1 << 63)})
    place = F.when(F.col("id").isNull(), F.lit(0)).otherwise(_above(bounds, F.col("id")) + 1)
    step = F.floor((F.shiftrightunsigned("h", 1) / float(1 << 63)) * _STEPS).cast("int")  # of the hash as an unsigned number
    split = F.col("id").isin(alone) | F.lit(None in heavy) & F.col("id").isNull()
    placed = base.withColumn("range", place * _STEPS + F.when(split, F.least(step, F.lit(_STEPS - 1))).otherwise(0))
    order = (F.shiftrightunsigned("h", 1), F.col("h"))
    firsts = placed.groupBy("range").agg(F.min(F.struct(F.col("id"), order[0].alias("u"), F.col("h"))).alias("f")).select("range", "f.id", "f.h").orderBy("range").collect()  # a row a range
    used = [r["range"] for r in firsts]
    before = dict(zip(used[1:] + used[:1], used))  # the first range's guest goes to the last
    guests = spark.createDataFrame([(r["range"], before[r["range"]], r["id"], r["h"]) for r in firsts], "range int, guest_of int, first_id long, first_h long")
    head = placed.join(F.broadcast(guests), "range").filter(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    lead_row = head.dropDuplicates(["range"]).select("id", "text", "h", F.col("guest_of").alias("range"), F.lit(1).alias("guest"))
    both = placed.select("id", "text", "h", "range", F.lit(0).alias("guest")).unionByName(lead_row)

    line = Window.partitionBy("range").orderBy("guest", "id", *order, "text")
    half = F.floor(F.length("text") / 2).cast("int")
    seen = both.repartition(ranges, "range").withColumn("rn", F.row_number().over(line)).withColumn("next", F.lead("text").over(line))
    texts = seen.select(
        "range", "rn", "guest", "id", "text", F.length("text").cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)).alias("edited"),
    )
    digests = Written(texts.select("range", "rn", "guest", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256")), "digests")
    release(spark)
    sides = texts.select("range", "rn", F.explode(F.array(F.struct(F.lit(0).alias("side"), terms(F.col("text")).alias("t")), F.struct(F.lit(1).alias("side"), terms(F.col("edited")).alias("t")))).alias("s"))
    words = sides.select("range", "rn", F.col("s.side").alias("side"), F.explode("s.t").alias("word")).filter("word != ''").select("range", "rn", "side", F.xxhash64("word").alias("term"))
    counts = words.groupBy("range", "rn", "term").agg(F.sum(1 - F.col("side")).alias("w0"), F.sum("side").alias("w1"))
    # a row a term and `_TOGETHER` samples: few rows to look up, and a loop small enough
    # to be compiled; logarithms of weights stand below the generator, once a term. All
    # steps need the texts' own ranges only, so none of these rows is shuffled
    logs = counts.select("range", "rn", "term", *(F.when(F.col(w) == 1, F.lit(0.0)).when(F.col(w) > 1, F.ln(w)).alias(f"l{w[1]}") for w in ("w0", "w1")))
    each = logs.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(0, samples, _TOGETHER)))))
    drawn = [(s, j) for s in (0, 1) for j in range(_TOGETHER)]
    minima = each.groupBy("range", "rn", "k").agg(*(F.min(sample(F.col("term"), F.col(f"l{s}"), F.col("k") + j)).alias(f"m{s}_{j}") for s, j in drawn))
    sets = (F.array(*(F.col(f"m{s}_{j}") for j in range(_TOGETHER))).alias(f"m{s}") for s in (0, 1))
    ranked = minima.select("range", "rn", "k", *sets).groupBy("range", "rn").agg(F.sort_array(F.collect_list(F.struct("k", "m0", "m1"))).alias("m"))
    ranked = ranked.select("range", "rn", *(F.slice(F.flatten(f"m.m{s}"), 1, samples).alias(f"m{s}") for s in (0, 1)))
    prints = Written(ranked.select("range", "rn", _shown(F.col("m0")).alias("fingerprint"), _shown(F.col("m1")).alias("edited_fingerprint")), "prints")
    release(spark)
    rows = digests.df.join(prints.df, ["range", "rn"], "left")
    rows = rows.fillna("", ["fingerprint", "edited_fingerprint"])
    rows = rows.withColumn("next_print", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("rn"))).filter("guest = 0")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print"), samples).alias("near_next"),
    )
