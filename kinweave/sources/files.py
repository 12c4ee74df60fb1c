"""Loading source files: CSV by schema, guarded appends, manifests, JSON results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.storage import shared_folder

#: Key, batch and payload of a source row; keys and batches are never null.
SOURCE_SCHEMA = (
    "source_system string, source_row_id int, entity_id long, ingest_batch int, observed_at string, npi string, name_raw string, street string, suite string, "
    "city string, state string, zip string, phone string, specialty string, multi boolean, moved boolean, network_status string"
)
KEY = ["source_system", "source_row_id"]


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; null and the empty text stay apart."""
    rows.write.option("header", True).option("nullValue", "\\N").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str = SOURCE_SCHEMA) -> DataFrame:
    """Columns by schema; a row that does not fit it stops the load."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "\\N").option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def manifest(rows: DataFrame) -> DataFrame:
    """Rows and a sum over row hashes for each source and batch: independent of the order of rows."""
    digest = F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).cast("string")
    return rows.groupBy("source_system", "ingest_batch").agg(F.count("*").alias("n"), digest.alias("digest"))


def verify(rows: DataFrame, expected: DataFrame) -> None:
    """Raises where rows differ from a manifest; at most a row a source and batch is read."""
    kinds = ["source_system", "ingest_batch"]
    found = manifest(rows).select(*kinds, F.col("n").alias("got"), F.col("digest").alias("got_digest"))
    wrong = expected.join(found, kinds, "full").filter(~(F.col("n").eqNullSafe(F.col("got")) & F.col("digest").eqNullSafe(F.col("got_digest")))).limit(5).collect()
    if wrong:
        raise ValueError(f"rows differ from the manifest: {wrong}")


def guard(rows: DataFrame) -> None:
    """Raises on rows without key or batch, and on keys met twice."""
    bare = rows.filter(F.col("source_system").isNull() | F.col("source_row_id").isNull() | F.col("ingest_batch").isNull()).limit(1).count()
    if bare:
        raise ValueError("a row has no key or no batch")
    twice = rows.groupBy(*KEY).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys met more than once: {twice}")


def append_batch(rows: DataFrame, path: str) -> None:
    """Adds batches to a table; refuses batches that stand there already, so that a load
    repeated by mistake changes nothing."""
    spark = rows.sparkSession
    guard(rows)
    new = {r[0] for r in rows.select("ingest_batch").distinct().collect()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        there = {r[0] for r in spark.read.parquet(path).select("ingest_batch").distinct().collect()}
        if both := sorted(new & there):
            raise ValueError(f"batches {both} are loaded already")
    rows.write.mode("append").partitionBy("ingest_batch").parquet(path)


def load_and_verify(rows: DataFrame) -> DataFrame:
    """rows through CSV, guard, append and manifest; counts of what stands there."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/load-{uuid.uuid4().hex}"
    write_csv(rows, f"{folder}/csv")
    loaded = read_csv(spark, f"{folder}/csv")
    append_batch(loaded, f"{folder}/table")
    table = spark.read.parquet(f"{folder}/table").select(*rows.columns)
    verify(table.withColumn("ingest_batch", F.col("ingest_batch").cast("int")), manifest(rows))
    return table.groupBy("source_system", F.col("ingest_batch").cast("int").alias("ingest_batch")).agg(F.count("*").alias("n"), F.count("npi").alias("with_npi"), F.count("suite").alias("with_suite"), F.count("street").alias("with_street"))


def write_json(results: dict, path: str) -> None:
    """A result document in a fixed layout: equal results give equal bytes."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(results, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def explain_summary(df: DataFrame) -> dict[str, int]:
    """How often each physical operator stands in df's plan."""
    counts: dict[str, int] = {}
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        words = line.lstrip(" :+-*").split()
        if words and words[0].startswith("(") and len(words) > 1:
            words = words[1:]
        if words:
            counts[words[0]] = counts.get(words[0], 0) + 1
    return counts
