import random

from pyspark.sql import functions as F

from kinweave.functions import normalize as N
from kinweave.operators.blocking import STRATEGIES, block_counts
from kinweave.operators.components import connected_components
from kinweave.operators.survivorship import lineage_violations, survive


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (7, 7), (300, 300), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 300: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ROSTER = "source_system string, source_row_id int, entity_id long, npi string, zip string, surname4 string, family_soundex string, state string, phone string"


def test_blocks_are_counted_as_their_pairs_are(spark):
    rng = random.Random(3)
    pick = lambda n: rng.choice([None, *map(str, range(n))])
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)]), rng.choice([None, *range(30)]), pick(60), pick(4), pick(5), pick(3), pick(3), pick(50)) for _ in range(150)]
    rows += rows[:20] + rows[:5]  # equal rows, beside ids with several forms
    names = [c.split(" ")[0] for c in ROSTER.split(", ")]
    records = [dict(zip(names, r)) for r in rows]
    mine: dict[tuple, list] = {}
    for r in records:
        mine.setdefault((r["source_system"], r["source_row_id"]), []).append(r["entity_id"])
    want = {n: [0, 0] for n in [*STRATEGIES, "union"]}
    for r in records:
        for s in records:
            a, b = ((x["source_system"], x["source_row_id"]) for x in (r, s))
            if a[1] is None or b[1] is None or a >= b:
                continue
            by = [n for n, on in STRATEGIES.items() if all(r[k] is not None and r[k] == s[k] for k in on)]
            for n in by + ["union"] * bool(by):
                want[n][0] += len(mine[a]) * len(mine[b])
                want[n][1] += sum(x is not None and x == y for x in mine[a] for y in mine[b])
    got = {r.strategy: [r.candidates, r.true_found] for r in block_counts(spark.createDataFrame(rows, ROSTER)).collect()}
    assert got == want and all(min(x) > 0 for x in want.values())
    none = block_counts(spark.createDataFrame([], ROSTER)).collect()
    assert {(r.strategy, r.candidates, r.true_found) for r in none} == {(n, 0, 0) for n in want}


def test_a_large_block_is_counted_without_its_pairs(spark):
    n = 300_000
    rows = spark.range(n).selectExpr("'a' as source_system", "cast(id as int) as source_row_id", "id div 2 as entity_id", "cast(id as string) as npi", "'z' as zip", "cast(id as string) as surname4", "'S' as family_soundex", "'NY' as state", "cast(id div 3 as string) as phone")
    got = {r.strategy: (r.candidates, r.true_found) for r in block_counts(rows).collect()}
    assert got == {"npi_exact": (0, 0), "zip_surname4": (0, 0), "soundex_state": (n * (n - 1) // 2, n // 2), "phone_exact": (n, n // 3), "union": (n * (n - 1) // 2, n // 2)}


def test_normalisers(spark):
    rows = [("payer_feed", "LEE, Ann, M.D."), ("site_scrape", "Dr. Bob Ray and Pat Smith"), ("x", "Cher"), ("payer_feed", "LEE, DO")]
    df = spark.createDataFrame(rows, "s string, n string")
    got = [tuple(r) for r in df.select(N.given_name(F.col("s"), F.col("n")), N.family_name(F.col("s"), F.col("n"))).collect()]
    assert got == [("ANN", "LEE"), ("BOB", "RAY"), (None, None), (None, None)]
    ids = spark.createDataFrame([("1 (415) 555-0123", "12", "ny "), ("415", "12345-6", "nyc")], "p string, z string, t string")
    assert [tuple(r) for r in ids.select(N.clean_phone(F.col("p")), N.clean_zip(F.col("z")), N.clean_state(F.col("t"))).collect()] == [("4155550123", None, "NY"), (None, "12345", None)]
    codes = spark.createDataFrame([("Ashcraft",), ("Pfister",), ("",), (None,)], "n string").select(N.soundex(F.col("n")))
    assert [r[0] for r in codes.collect()] == ["A226", "P236", None, None]


def test_survivorship(spark):
    rows = [(1, "x", "a", 1, "2024-01-01"), (1, "y", "b", 2, "2024-03-01"), (1, "x", "c", 3, "2024-02-01"), (1, None, "a", 0, "2024-09-01"), (2, "z", "c", 9, "2024-01-01")]
    df = spark.createDataFrame(rows, "cluster int, value string, source string, key long, seen string")
    got = {r.cluster: r for r in survive(df, ["cluster"], ["b", "a"]).collect()}
    one, two = got[1], got[2]
    assert (one.first_key, one.recent_key, one.majority_value, one.majority_key, one.priority_key) == (1, 2, "x", 3, 2)
    assert two.priority_value == "z"
    g = survive(df, ["cluster"], ["b", "a"])
    assert lineage_violations(g, df, ["cluster"], "priority_value", "priority_key").count() == 0
    assert lineage_violations(g.withColumn("priority_value", F.lit("q")), df, ["cluster"], "priority_value", "priority_key").count() == 2


def test_entry_imports():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"block_union_distinct", "fs_scores", "surv_golden", "ovr_replay"} <= names
    assert set(e.oracle_sql()) <= names
