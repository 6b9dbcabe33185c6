"""Scratch tables, distributed ranking and connected components used by several operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of the tables that materialize() wrote
_step: ContextVar[list[str] | None] = ContextVar("step", default=None)  # the folders written in a recording() block


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where it is unset a folder of this machine serves a local session; on a cluster executors couldn't read each other's
    files there, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "corpusmill-scratch")
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    if (written := _step.get()) is not None:
        written.append(path)
    return table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def recording(written: list[str]) -> Iterator[None]:
    """A block whose scratch folders are added to `written`, a list of the caller's own."""
    token = _step.set(written)
    try:
        yield
    finally:
        _step.reset(token)


def delete(spark: SparkSession, paths: list[str], but: DataFrame | None = None) -> None:
    """Delete recorded folders, except that of the table `but`; empties the list to what is left."""
    kept = _folders.get(but) if but is not None else None
    for path in paths:
        if path != kept:
            _delete(spark, path)
    paths[:] = [p for p in paths if p == kept]


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more: what was made of them has been written itself."""
    for table in tables:
        path = _folders.pop(table, None) if table is not None else None
        if path is not None:
            _delete(table.sparkSession, path)


def numbered(df: DataFrame, label: str, row: str = "__row") -> DataFrame:
    """df, written with a number for each row.

    A later scan may cut the same files into other partitions and so give other numbers: they are only read, never made twice.
    """
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), label)


def identified(df: DataFrame, label: str, row: str = "__row") -> DataFrame:
    """df with a name for each row that every scan gives alike: its file and place there. What isn't a plain table of files is numbered."""
    try:
        return df.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    except AnalysisException:
        return numbered(df, label, row)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def globally_ranked(df: DataFrame, order: list[Column], rank: str, label: str) -> DataFrame:
    """df with a gapless 0-based rank by `order`, without any single-task window.

    Rows are range-partitioned and sorted, written with their place, and shifted by the sizes of the
    partitions before theirs: one small row a partition is all that is gathered.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    laid = materialize(laid.withColumn("__place", F.monotonically_increasing_id()), label)
    laid = laid.withColumn("__part", F.shiftright("__place", _ROW_BITS))
    sizes = laid.groupBy("__part").agg(F.count("*").alias("__n")).collect()  # a row a partition
    before, starts = 0, []
    for part, n in sorted((r["__part"], r["__n"]) for r in sizes):
        starts.append((part, before))
        before += n
    schema = T.StructType([T.StructField("__part", T.LongType()), T.StructField("__before", T.LongType())])
    starts_df = F.broadcast(spark.createDataFrame(starts, schema))
    place = F.col("__place").bitwiseAND((1 << _ROW_BITS) - 1)
    return laid.join(starts_df, "__part").withColumn(rank, place + F.col("__before")).drop("__place", "__part", "__before")


def connected_components(edges: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for nodes that have a smaller one.

    Alternating large-star and small-star steps (each one grouped minimum and one join, so a hub's
    edges never expand into pairs) until a step changes nothing.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def summary(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    current = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct(), label)
    if current.isEmpty():
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = summary(current)
    while True:
        whole = both(current)
        least = whole.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every neighbour above u goes to the least of u and its neighbours
        large = whole.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v")
        # small star: u and its neighbours below go to the least of these
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            down.select("u", F.col("m").alias("v"))
        )
        before, current = current, materialize(small.filter("u != v").distinct(), label)
        discard(before)
        now = summary(current)
        if now == seen:
            out = materialize(current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), label)
            discard(current)
            return out
        seen = now


ID_BITS = 1 << 26  # bits of id_bits(): 8 MB at most, whatever the number of ids
_PAGE = 1 << 15  # of bitmap_construct_agg


def id_bits(ids: DataFrame, col: str) -> DataFrame:
    """(page, bits): the ids' hashes as pages of a bitmap, a bounded table that may be broadcast."""
    cell = F.pmod(F.xxhash64(F.col(col)), F.lit(ID_BITS))
    pages = ids.select(F.expr(f"{_PAGE}").alias("__size"), cell.alias("__cell"))
    pages = pages.groupBy(F.expr("__cell div __size").alias("__page")).agg(F.bitmap_construct_agg(F.col("__cell") % F.col("__size")).alias("__bits"))
    return F.broadcast(pages)


def _marked(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """rows with `__maybe`: whether the bitmap of ids holds the hash of `col`."""
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64(F.col(col)), F.lit(ID_BITS))).withColumn("__page", F.expr(f"__cell div {_PAGE}"))
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast((__cell % {_PAGE}) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.expr("cast(1 as int) << cast(__cell % 8 as int)")
    held = F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    return rows.join(id_bits(ids, col), "__page", "left").withColumn("__maybe", held).drop("__cell", "__page", "__bits")


def marked_ids(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """rows with `__maybe`: false only where ids doesn't hold `col`; true for all that it holds and, rarely, for others."""
    return _marked(rows, ids, col)


def only_ids(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows whose `col` is in ids (a distinct, written table of that column).

    Rows that a broadcast bitmap of the ids' hashes rules out aren't dealt: only the others meet the ids by a shuffle.
    """
    return _marked(rows, ids, col).filter("__maybe").drop("__maybe").join(ids, col, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows whose `col` isn't in ids, null included; dealt as in only_ids()."""
    marked = _marked(rows, ids, col)
    return marked.filter("NOT __maybe").unionByName(marked.filter("__maybe").join(ids, col, "left_anti")).drop("__maybe")


_NO_ID = -(2**63)  # stands for a null id inside Python tasks, where nulls would turn ids into floats


def id_or_least(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(_NO_ID))


def without_least(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(_NO_ID))
