"""Full-text search over a stored index of postings: stems to rows, read by bucket, never the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.stemming import stem, stem_each

BUCKETS = 64
SPLIT = 16  # files over which one stem's rows are spread


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(stem, key), distinct: the stems of all fields' words but stop words. Each distinct word is stemmed once."""
    tokens = [docs.select(key, F.explode(X.search_tokens(f, stem=False)).alias("word")) for f in fields]
    each = reduce(DataFrame.unionByName, tokens)
    stems = each.select("word").distinct().withColumn("stem", stem_each(F.col("word")))
    return each.join(stems, "word").select("stem", key).distinct()


def _bucket(c):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def write_index(rows: DataFrame, key: str, path: str) -> None:
    """Postings by bucket of the stem; a frequent stem's rows are in several files, each sorted, so that row groups can be skipped."""
    dealt = rows.withColumn("bucket", _bucket("stem")).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(SPLIT)))
    dealt = dealt.repartition("bucket", "__part").sortWithinPartitions("bucket", "stem", key).drop("__part")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def find(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(key) of the rows that have every word of the query, by stems: only those stems' buckets are read.

    A query without words (or of stop words alone) finds nothing, as no posting answers it.
    """
    index = spark.read.parquet(path)
    key = next(c for c in index.columns if c not in ("stem", "bucket"))
    words = spark.range(1).select(F.explode(X.search_tokens(F.lit(query), stem=False)).alias("w")).collect()  # of the query
    stems = sorted({stem(r["w"]) for r in words})
    if not stems:
        return index.select(key).limit(0)
    buckets = [r[0] for r in spark.createDataFrame([(s,) for s in stems], "s string").select(_bucket("s")).distinct().collect()]
    hits = index.filter(F.col("bucket").isin(buckets) & F.col("stem").isin(stems))
    return hits.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(stems)).select(key)
