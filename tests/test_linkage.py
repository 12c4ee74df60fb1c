"""Normalisers, load guards, curve guards and survivorship on small tables."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import normalize as N
from kinweave.operators.survivorship import survive
from kinweave.plans import evaluate
from kinweave.sources import files


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_names(spark):
    rows = [("payer_feed", "LEE, Mary Ann, M.D."), ("payer_feed", "NO COMMA"), ("site_scrape", "Dr. Ana Ruiz, DO and Wei Zhang, MD"), ("clearinghouse", "Single"), ("clearinghouse", None), ("payer_feed", "LEE,")]
    got = values(spark, rows, "s string, n string", N.given_name(F.col("s"), F.col("n")), N.family_name(F.col("s"), F.col("n")), N.persons(F.col("n")), N.credential(F.col("n")))
    assert got == [("MARY ANN", "LEE", ["LEE, Mary Ann, M.D."], "MD"), (None, None, ["NO COMMA"], None), ("ANA", "RUIZ", ["Dr. Ana Ruiz, DO", "Wei Zhang, MD"], "DO"), (None, None, ["Single"], None), (None, None, [], None), (None, "LEE", ["LEE,"], None)]


def test_streets_and_suites(spark):
    rows = [("12 Oak Pkwy", None), ("12 Oak Parkway # 203", None), ("12 N Oak Ter. Suite 4-B", None), ("9 Grand Esplanade", "Ste. 203"), (None, "UNIT 7"), ("", "")]
    got = values(spark, rows, "street string, suite string", N.street_tokens(F.col("street")), N.clean_suite(F.col("suite"), F.col("street")))
    assert got == [(["12", "OAK", "PARKWAY"], None), (["12", "OAK", "PARKWAY"], "SUITE 203"), (["12", "NORTH", "OAK", "TERRACE"], "SUITE 4-B"), (["9", "GRAND", "ESPLANADE"], "SUITE 203"), (None, "SUITE 7"), ([], None)]


def test_every_form_of_a_street_word_folds_to_it():
    assert all(N.STREET_WORDS[short] == word for word, forms in N.STREET_FORMS.items() for short in forms.split())
    assert len(N.NICKNAMES) == 36 and N.NICKNAMES["CILLA"] == "PRISCILLA"


SOURCE = "source_system string, source_row_id int, ingest_batch int, suite string"


def test_loads_are_guarded(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, ""), ("a", 2, 1, None), ("b", 1, 1, 'say "x", y')], SOURCE)
    files.write_csv(rows, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), SOURCE)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    table = str(tmp_path / "table")
    files.append_batch(back, table)
    with pytest.raises(ValueError, match="loaded already"):
        files.append_batch(back, table)
    files.append_batch(rows.withColumn("ingest_batch", F.lit(2)).withColumn("source_row_id", F.col("source_row_id") + 10), table)
    assert spark.read.parquet(table).count() == 6
    files.verify(back, files.manifest(rows))
    with pytest.raises(ValueError, match="manifest"):
        files.verify(back.filter("source_row_id = 1"), files.manifest(rows))
    with pytest.raises(ValueError, match="more than once"):
        files.guard(rows.unionByName(rows))
    with pytest.raises(ValueError, match="no key"):
        files.guard(spark.createDataFrame([("a", None, 1, None)], SOURCE))


def test_results_and_plans(spark, tmp_path):
    path = str(tmp_path / "r.json")
    files.write_json({"b": 1, "a": [None, "\u00e9"]}, path)
    assert files.read_json(path) == {"a": [None, "\u00e9"], "b": 1}
    assert sum(files.explain_summary(spark.range(5).groupBy("id").count()).values()) > 2


def test_curve_guards(spark):
    curve = lambda rows: spark.createDataFrame(rows, "threshold double, tp long, fp long")
    evaluate.check_curve(curve([(0.0, 9, 5), (1.0, 8, 2), (2.0, 1, 0)]))
    with pytest.raises(ValueError, match="rises"):
        evaluate.check_curve(curve([(0.0, 7, 5), (1.0, 8, 2)]))
    with pytest.raises(ValueError, match="same pairs"):
        evaluate.check_curve(curve([(0.0, 7, 5), (1.0, 7, 5)]))


def test_damage(spark):
    scores = spark.createDataFrame([("s", 1, "s", 2, 9.0, True, 2), ("s", 2, "s", 3, 6.0, False, 2)], "a_sys string, a_id int, b_sys string, b_id int, score double, is_match boolean, entity long")
    rows = spark.createDataFrame([("s", 1, 2), ("s", 2, 2), ("s", 3, 4), ("s", 4, 4), ("s", 5, 5)], "source_system string, source_row_id int, entity_id long")
    got = {r.threshold: r for r in evaluate.damage_sweep(scores, rows, [5.0, 8.0, 99.0]).collect()}
    assert (got[5.0].clusters, got[5.0].welded, got[5.0].rows_welded, got[5.0].worst, got[5.0].split, got[5.0].false_share) == (2, 1, 3, 2, 1, 0.5)
    assert (got[8.0].clusters, got[8.0].welded, got[8.0].accepted_true, got[99.0].clusters, got[99.0].accepted) == (3, 0, 1, 4, 0)


def test_priority_by_field(spark):
    rows = [(1, "npi", "x", "p", 1, 5), (1, "npi", "y", "q", 2, 1), (1, "zip", "x", "p", 1, 5), (1, "zip", "y", "q", 2, 1), (1, "zip", None, "q", 3, 9)]
    got = survive(spark.createDataFrame(rows, "c int, field string, value string, source string, key long, seen int"), ["c", "field"], {"npi": ["q", "p"], "zip": ["p"]})
    assert {(r.field, r.priority_value, r.priority_source, r.priority_key) for r in got.collect()} == {("npi", "y", "q", 2), ("zip", "x", "p", 1)}
