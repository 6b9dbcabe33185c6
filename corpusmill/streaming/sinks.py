"""Sinks that a replayed micro-batch leaves as they were: what batch k writes depends on the batches before k alone and replaces itself."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches that have been written whole, in order."""
    path, files = _folder(spark, folder)
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _before(spark: SparkSession, folder: str, batch: int, schema: str) -> DataFrame | None:
    """What the last batch before `batch` wrote."""
    earlier = [b for b in _batches(spark, folder) if b < batch]
    return spark.read.schema(schema).parquet(f"{folder}/batch={earlier[-1]}") if earlier else None


def _forget(spark: SparkSession, folder: str, batch: int) -> None:
    """Delete all but the last two batches: a replay needs the one before it."""
    for b in _batches(spark, folder):
        if b < batch - 1:
            path, files = _folder(spark, f"{folder}/batch={b}")
            files.delete(path, True)


def _started(stream: DataFrame, each, checkpoint: str, mode: str) -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def split_late(stream: DataFrame, folder: str, checkpoint: str, time: str = "created_at", delay: dt.timedelta = dt.timedelta(minutes=10)) -> StreamingQuery:
    """Rows in time and late rows, side by side: a row is late if an earlier micro-batch held one more than `delay` newer (or as much).

    That is the rule by which a watermark of that delay drops rows without a word; here they are kept, see accepted() and late().
    """
    schema = stream.schema

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        mark = _before(spark, f"{folder}/marks", batch, "high timestamp")
        high = mark.first()["high"] if mark is not None else None  # watermarks are whole milliseconds
        is_late = F.lit(False) if high is None else F.coalesce(F.col(time) <= F.lit(high.replace(microsecond=high.microsecond // 1000 * 1000) - delay), F.lit(False))
        df.withColumn("__late", is_late).write.partitionBy("__late").mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        written = _rows(spark, folder, schema).filter(F.col("batch") == batch)
        marks = written.agg(F.greatest(F.max(time), F.lit(high).cast("timestamp")).alias("high"))
        marks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={batch}")
        _forget(spark, f"{folder}/marks", batch)

    return _started(stream, each, checkpoint, "append")


def _rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    more = [T.StructField("batch", T.IntegerType()), T.StructField("__late", T.BooleanType())]
    return spark.read.schema(T.StructType([*schema.fields, *more])).parquet(f"{folder}/rows")


def accepted(spark: SparkSession, folder: str, schema) -> DataFrame:
    return _rows(spark, folder, schema).filter("NOT __late").drop("__late", "batch")


def late(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The late rows, with the number of their micro-batch."""
    return _rows(spark, folder, schema).filter("__late").drop("__late")


def changed_snapshots(stream: DataFrame, folder: str, checkpoint: str, key: str, value: str, threshold: int | None = None) -> StreamingQuery:
    """Live (key, value) rows in update mode -> those over the threshold whose value isn't the one last emitted for their key.

    Emissions are in `folder`/emitted by batch; `folder`/last has each key's last value, from which a batch, replayed or
    not, finds what has changed.
    """
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {value} {stream.schema[value].dataType.simpleString()}"

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        over = df.select(key, value) if threshold is None else df.select(key, value).filter(F.col(value) > threshold)
        last = _before(spark, f"{folder}/last", batch, schema)
        if last is None:
            last = spark.createDataFrame([], schema)
        old = last.select(F.col(key).alias("__k"), F.col(value).alias("__old"))
        new = over.join(old, over[key].eqNullSafe(old["__k"]), "left").filter(F.col("__k").isNull() | ~F.col("__old").eqNullSafe(F.col(value)))
        new.select(key, value).write.mode("overwrite").parquet(f"{folder}/emitted/batch={batch}")
        new = spark.read.schema(schema).parquet(f"{folder}/emitted/batch={batch}")
        kept = last.join(new.select(F.col(key).alias("__k")), last[key].eqNullSafe(F.col("__k")), "left_anti")
        kept.unionByName(new).write.mode("overwrite").parquet(f"{folder}/last/batch={batch}")
        _forget(spark, f"{folder}/last", batch)

    return _started(stream, each, checkpoint, "update")


def emitted(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What has been emitted, with the number of the micro-batch."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/emitted")


def budget_alerts(stream: DataFrame, threshold: int, folder: str, checkpoint: str) -> StreamingQuery:
    """Live counts by bucket; see changed_snapshots()."""
    return changed_snapshots(stream.groupBy("bucket").agg(F.count("*").alias("n")), folder, checkpoint, "bucket", "n", threshold)
