"""The catalogue's relations, viewed over the driver tables (in Spark, and as SQL for the oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "4m"  # of texts that go to Python at once


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts go to Python: the session's Arrow batches are bounded by bytes, as 10,000 texts are of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return table(spark, sf_dir, name)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "pending").otherwise("fail")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("date"), qa.alias("qa_status"),
        F.substring("o_orderpriority", 1, 1).isin("1", "2").alias("has_figures"), F.col("o_totalprice").alias("amount"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("subject"))
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).select("paper_id", "subject").distinct()


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories are the first letters of part types, in alphabetical order; the first is pinned; positions are the types' order."""
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("subject")).distinct()
    kinds = kinds.withColumn("category_id", F.substring("subject", 1, 1))
    # one row a part type
    return kinds.select(
        "category_id", F.dense_rank().over(Window.orderBy("category_id")).alias("category_order"), F.row_number().over(Window.orderBy("subject")).alias("position"), "subject"
    ).withColumn("pinned", F.col("category_order") == 1)


PAPERS = """papers AS (SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS date,
  CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'pending' ELSE 'fail' END AS qa_status,
  substr(o_orderpriority, 1, 1) IN ('1', '2') AS has_figures, o_totalprice AS amount FROM orders)"""
SUBJECTS = """subjects AS (SELECT DISTINCT l_orderkey AS paper_id, p_type AS subject FROM lineitem JOIN part ON l_partkey = p_partkey)"""
COUNTS = """counts AS (SELECT subject, count(DISTINCT paper_id) AS papers FROM subjects JOIN papers ON paper_id = id WHERE qa_status = 'pass' GROUP BY subject)"""
TAXONOMY = """kinds AS (SELECT DISTINCT p_type AS subject, substr(p_type, 1, 1) AS category_id FROM part),
taxonomy AS (SELECT category_id, dense_rank() OVER (ORDER BY category_id) AS category_order, row_number() OVER (ORDER BY subject) AS position,
  subject, dense_rank() OVER (ORDER BY category_id) = 1 AS pinned FROM kinds)"""
