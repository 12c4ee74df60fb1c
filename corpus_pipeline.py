"""The corpus pipeline: five stages over `documents`, each on all rows its
predecessor kept. Every stage but the last returns the columns of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.line_dedup import line_dedup
from kinweave.llm.ngram_jaccard import ngram_jaccard_join, row_hash
from kinweave.llm.packing import best_fit_packing
from kinweave.llm.queries import vocabulary
from kinweave.llm.substring_dedup import substring_dedup
from kinweave.llm.toxicity import fit_toxicity, score_toxicity
from kinweave.plans.storage import shared_folder, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of like lines stays; all documents stay."""
    return _replaced(docs, line_dedup(docs, carry=_carried(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like documents stays: the rows that the
    operator keeps, told apart by id and text. Of rows equal in both, of which it
    keeps one, one stays."""
    found = ngram_jaccard_join(docs, row_col="_row").groupBy("_row").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).filter("k > 0")
    marks = written(found.select("_row", (F.col("k") < F.col("n")).alias("repeated")), "kept")
    keyed = docs.withColumn("_row", row_hash("doc_id", "text"))
    single = keyed.join(marks.filter("not repeated"), "_row", "left_semi")
    repeated = keyed.join(marks.filter("repeated"), "_row", "left_semi").dropDuplicates(["_row"])
    return single.unionByName(repeated).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that repeat are cut; texts without any keep their layout."""
    return _replaced(docs, substring_dedup(docs, carry=_carried(docs), layout=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences."""
    return best_fit_packing(docs, vocabulary())


def _carried(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]


def _replaced(docs: DataFrame, found: DataFrame) -> DataFrame:
    changed = found.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return changed.select(*docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substrings),
    ("packing", packing),
]

#: SQL has no way to train a classifier; tests compare line_dedup, ngram_jaccard and
#: substring_dedup with brute force and packing by its token totals, on a small table,
#: the classifier's margins with a plain kernel, and `run` with its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
