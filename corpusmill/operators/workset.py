"""What to work on next: queues, claims, gaps and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def work_queue(papers: DataFrame, as_of: Column, mode: str = "default", include_failed: bool = False) -> DataFrame:
    """Default: pending, in progress for over 4 hours, or failed over 7 days ago; a null start is never overdue."""
    s, at = F.col("processing_status"), F.col("processing_started_at")
    if mode == "text_only":
        cond = F.coalesce(F.col("text_status") != "complete", F.lit(True))
    elif mode == "figures_only":
        cond = (F.col("text_status") == "complete") & F.coalesce(F.col("figures_status") != "complete", F.lit(True))
    else:
        failed = F.lit(True) if include_failed else at < as_of - F.expr("INTERVAL 7 DAYS")
        cond = (s == "pending") | ((s == "processing") & (at < as_of - F.expr("INTERVAL 4 HOURS"))) | ((s == "failed") & failed)
    return papers.filter(F.coalesce(cond, F.lit(False)))


def needs_translation(papers: DataFrame, n: int) -> DataFrame:
    """Pending or failed with a title, newest first, undated last."""
    titled = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("source_title"), F.lit(""))).isNotNull()
    return papers.filter(F.col("text_status").isin("pending", "failed") & titled).orderBy(F.desc_nulls_last("date"), "id").limit(n)


def batch(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """B6."""
    return papers.join(ids.select("id").distinct(), "id", "left_semi")


def claimable(papers: DataFrame, as_of: Column) -> DataFrame:
    """Rows that no live worker holds."""
    free = ~F.col("processing_status").eqNullSafe(F.lit("processing")) | (F.col("processing_started_at") < as_of - F.expr("INTERVAL 4 HOURS"))
    return papers.filter(F.coalesce(free, F.lit(False)) & ~F.col("processing_status").eqNullSafe(F.lit("complete")))


def resume(worklist: DataFrame, statuses: DataFrame, stage: str) -> DataFrame:
    """Complete ids are skipped unless the stage isn't; ids without a status stay."""
    done = F.col("processing_status").eqNullSafe(F.lit("complete")) & F.col(f"{stage}_status").eqNullSafe(F.lit("complete"))
    known = statuses.select("id", "processing_status", f"{stage}_status")
    return worklist.join(known, "id", "left").filter(~done).select(*worklist.columns)


def job_counts(jobs: DataFrame, seconds_each: int = 25) -> DataFrame:
    """One row: counts by status, progress in percent, and the time left once any job is done."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("pending", "in_progress", "completed", "failed")}
    out = jobs.agg(F.count("*").alias("total"), *n.values())
    progress = F.coalesce(F.round(F.try_divide(F.col("completed").cast("double") * 100, F.col("total")), 1), F.lit(0.0))
    return out.withColumns({"progress": progress, "eta_seconds": F.when(F.col("completed") > 0, F.col("pending") * seconds_each)})


def recent_completions(jobs: DataFrame, n: int = 10) -> DataFrame:
    """T5: newest first; a time that can't be read comes last."""
    at = F.try_to_timestamp("completed_at")
    return jobs.filter(F.col("status") == "completed").orderBy(at.desc_nulls_last(), "id").limit(n)


def claim(jobs: DataFrame, n: int, most: int = 3) -> DataFrame:
    """The first n pending jobs with attempts left."""
    return jobs.filter((F.col("status") == "pending") & (F.col("attempts") < most)).orderBy("created_at", "id").limit(n)


def extreme_file(files: DataFrame, by: str) -> DataFrame:
    """The path with the largest name, time or size."""
    return files.agg(F.max_by("path", F.struct(by, "path")).alias("path"))


def newest_months(df: DataFrame, n: int = 3) -> DataFrame:
    """T11, D24."""
    return df.select("month").distinct().orderBy(F.desc("month")).limit(n)


def compact(jobs: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): all that isn't completed, and the newest completed ones; those without any time stay first."""
    at = F.coalesce("completed_at", "updated_at", "started_at", "created_at")
    done = jobs.filter(F.col("status") == "completed").withColumn("__at", at)
    # the last place that stays, found without ranking all rows in one task
    edge = done.orderBy(F.desc_nulls_first("__at"), F.desc("id")).limit(keep)
    kept = edge.select("id").withColumn("__keep", F.lit(True))
    marked = jobs.join(kept, "id", "left")
    stays = (F.col("status") != "completed") | F.col("__keep").isNotNull()
    return marked.filter(stays).drop("__keep"), marked.filter(~stays).drop("__keep")


def missing_numbers(df: DataFrame) -> DataFrame:
    """(month, number): numbers from 1 to a month's largest that it lacks; df has (month, number)."""
    top = df.groupBy("month").agg(F.max("number").alias("top"))
    every = top.select("month", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias("number"))
    return every.join(df.select("month", F.col("number").cast("long").alias("number")).distinct(), ["month", "number"], "left_anti")


def until_misses(probes: DataFrame, run: int = 50) -> DataFrame:
    """By month, the probes (number, hit) before the end of the first `run` misses in a row."""
    w = Window.partitionBy("month").orderBy("number")
    island = F.sum(F.col("hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    miss = probes.withColumn("island", island).filter("NOT hit")
    place = F.row_number().over(Window.partitionBy("month", "island").orderBy("number"))
    stop = miss.withColumn("rn", place).filter(F.col("rn") == run).groupBy("month").agg(F.min("number").alias("stop"))
    return probes.join(stop, "month", "left").filter("stop IS NULL OR number < stop").drop("stop")


def month_list(df: DataFrame, start: str, end: str) -> DataFrame:
    """yyyyMM for each month from date column start to end."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    return df.select(F.explode(months).alias("d")).select(F.date_format("d", "yyyyMM").alias("month"))


def harvest_progress(df: DataFrame, months: DataFrame) -> DataFrame:
    """(month, n, complete) for every expected month."""
    counts = df.groupBy("month").agg(F.count("*").alias("n"))
    return months.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("complete"))


def first_missing(progress: DataFrame) -> DataFrame:
    """D37."""
    return progress.filter("NOT complete").agg(F.min("month").alias("month"))
