"""Requests, costs, errors, alerts and events: counts, budgets, streaks, retention and limits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.sources.scratch import new_folder

SEVERITIES = ("info", "warning", "error", "critical")


def newer_than(df: DataFrame, column: str, cutoff: Column, keep_invalid: bool = False) -> DataFrame:
    """Text times after the cutoff, without a zone in UTC; an equal time is out, one that can't be read by choice."""
    at = F.coalesce(F.try_to_timestamp(column), F.try_to_timestamp(F.concat(F.col(column), F.lit(" 00:00:00"))))
    return df.filter(F.coalesce(at > cutoff, F.lit(keep_invalid)))


def confirmed_transfers(df: DataFrame, address: str, symbols: list[str] | None = None, native: str = "ETH") -> DataFrame:
    """Transfers to an address without error and above zero; symbols: None native only, [] all, else these."""
    ok = F.col("confirmed") & (F.lower("to") == address.lower()) & ~F.coalesce("is_error", F.lit(False)) & (F.col("raw_value") > 0)
    if symbols is None:
        ok = ok & (F.col("symbol") == native)
    elif symbols:
        ok = ok & F.col("symbol").isin(symbols)
    return df.filter(ok)


def with_cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens by the price of the model, an unknown model costs 0."""
    joined = df.join(prices, "model", "left")
    cost = F.col("input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0))
    return joined.withColumn("cost", F.round(cost, 8)).drop("input_price", "output_price")


def with_license(df: DataFrame, meaning: DataFrame, raw: str = "license_raw") -> DataFrame:
    """The label of a licence text and what it allows; unknown is null, not false. meaning is a few rows."""
    return df.withColumn("label", X.license_label(raw)).join(meaning, "label", "left")


def with_day_price(events: DataFrame, prices: DataFrame, stable: tuple[str, ...] = ("USDC", "USDT", "DAI")) -> DataFrame:
    """C20: the price of a symbol on the event's UTC day; stable tokens are 1."""
    day = events.withColumn("day", F.to_date("at"))
    joined = day.join(prices.select("symbol", "day", "price"), ["symbol", "day"], "left")
    price = F.when(F.col("symbol").isin(*stable), F.lit(1).cast("decimal(38,18)")).otherwise(F.col("price").cast("decimal(38,18)"))
    return joined.withColumn("price", price).withColumn("value", (F.col("amount") * F.col("price").cast("decimal(20,8)")).cast("decimal(38,12)"))


def request_counts(df: DataFrame) -> DataFrame:
    """D8."""
    return df.groupBy("paper_id").agg(F.count("*").alias("n"))


def request_totals(df: DataFrame) -> DataFrame:
    """One row: (total, papers)."""
    return df.agg(F.count("*").alias("total"), F.countDistinct("paper_id").alias("papers"))


def ranked_requests(counts: DataFrame, n: int | None = None) -> DataFrame:
    """Rank from 1 by falling count, then key; with n the first n, which are taken before they are ranked.

    A whole ranking has no single task: rows are range-partitioned and sorted, written with their places, and shifted by
    the sizes of the partitions before theirs (a small row a partition).
    """
    order = [F.desc("n"), F.col("paper_id")]
    if n is not None:
        return counts.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    spark, folder = counts.sparkSession, new_folder(counts.sparkSession, "ranking")
    laid = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    laid.write.parquet(folder)
    laid = spark.read.schema(laid.schema).parquet(folder).withColumn("__part", F.shiftright("__place", 33))
    starts, before = [], 0
    for r in sorted(laid.groupBy("__part").count().collect()):
        starts.append((r["__part"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(starts, "__part long, __before long"))
    rank = (F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1).cast("int")
    return laid.join(starts, "__part").withColumn("rank", rank).drop("__place", "__part", "__before")


def run_totals(runs: DataFrame) -> DataFrame:
    """One row."""
    out = runs.agg(*[F.sum(c).alias(c) for c in ("attempted", "validated", "flagged", "cost")], F.max("completed_at").alias("last_updated"))
    pending = F.greatest(F.lit(0), F.col("attempted") - F.col("validated") - F.col("flagged"))
    progress = F.coalesce(F.round(F.try_divide(F.col("validated").cast("double") * 100, F.col("attempted")), 1), F.lit(0.0))
    return out.withColumns({"pending": pending, "progress": progress})


def daily_history(runs: DataFrame, measures: list[str], days: int | None = None, time: str = "completed_at") -> DataFrame:
    """Sums by day and their running totals; the last `days` days are cut out after that (one row a day)."""
    daily = runs.groupBy(F.to_date(time).alias("day")).agg(*[F.sum(m).alias(m) for m in measures])
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.select("*", *[F.sum(m).over(upto).alias(f"total_{m}") for m in measures])
    if days is None:
        return out
    last = F.max("day").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("__last", last).filter(F.col("day") > F.date_sub("__last", days)).drop("__last")


def error_buckets(errors: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(bucket, n): each error counts under total, its status, 5xx, its code and the code's alias."""
    alias = F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv])
    buckets = F.array_compact(F.array(
        F.lit("total"), F.concat(F.lit("status:"), F.col("status").cast("string")), F.when(F.col("status") >= 500, "status:5xx"),
        F.concat(F.lit("code:"), F.col("code")), F.concat(F.lit("code:"), F.element_at(alias, F.col("code"))),
    ))
    return errors.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def budget_breaches(buckets: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(bucket, n, threshold) where the count is over."""
    return buckets.join(thresholds, "bucket").filter(F.col("n") > F.col("threshold"))


def top_buckets(buckets: DataFrame, n: int = 5) -> DataFrame:
    """D18."""
    return buckets.orderBy(F.desc("n"), "bucket").limit(n)


def alert_groups(alerts: DataFrame, window: str = "60 seconds") -> DataFrame:
    """(key, start, n, severity, messages): per key and window, the highest severity and messages by falling count."""
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("level"))
    per = alerts.withColumn("__l", level).groupBy("key", F.window("at", window).alias("w"), "message").agg(F.count("*").alias("n"), F.max("__l").alias("l"))
    messages = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "message", "n"))), lambda m: F.struct(m["message"].alias("message"), m["n"].alias("n")))
    out = per.groupBy("key", "w").agg(F.sum("n").alias("n"), F.max("l").alias("l"), messages.alias("messages"))
    return out.select("key", F.col("w.start").alias("start"), "n", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(F.col("l").cast("int"), F.lit(1))).alias("severity"), "messages")


def metric_means(df: DataFrame, metrics: list[str], ok: Column) -> DataFrame:
    """(metric, mean) over rows without error, nulls left out."""
    long = df.filter(ok).select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"))


def inventory(counts: DataFrame) -> DataFrame:
    """A row a month: the last absolute count of each stage, so that repeated runs don't add up."""
    last = counts.groupBy("month", "stage").agg(F.max_by("n", "updated_at").alias("n"))
    return last.groupBy("month").pivot("stage", ["harvest", "text", "figures", "pdf"]).agg(F.first("n")).na.fill(0)


def prefix_stats(files: DataFrame) -> DataFrame:
    """(prefix, n, latest)."""
    return files.groupBy("prefix").agg(F.count("*").alias("n"), F.max("modified").alias("latest"))


def translated_figures(files: DataFrame) -> DataFrame:
    """Papers with anything under figures/<paper>/translated/."""
    return files.filter(F.col("path").rlike(r"(^|/)figures/[^/]+/translated/")).agg(F.countDistinct(F.regexp_extract("path", r"figures/([^/]+)/translated/", 1)).alias("papers"))


def figure_stats(df: DataFrame) -> DataFrame:
    """D27."""
    return df.agg(F.sum("figures").alias("total"), F.count_if(F.col("figures") > 0).alias("papers_with"), F.avg("figures").alias("mean"))


def model_comparison(df: DataFrame, baseline: str) -> DataFrame:
    """Models by cost (length / 4 tokens at a price) and their length against the baseline model's."""
    cost = F.round(F.col("length") / 4 * F.col("price"), 8)
    base = df.filter(F.col("model") == baseline).agg(F.max("length").alias("base"))
    out = df.crossJoin(F.broadcast(base))  # one row
    return out.select("model", "length", cost.alias("cost"), F.round(F.try_divide(F.col("length").cast("double") * 100, F.col("base")), 1).alias("pct_of_base")).orderBy("cost", "model")


def gap_report(missing: DataFrame, pages: int = 5, price: str = "0.08") -> DataFrame:
    """(month, n, cost), most gaps first."""
    return missing.groupBy("month").agg(F.count("*").alias("n")).withColumn("cost", F.col("n") * pages * F.lit(price).cast("decimal(10,2)")).orderBy(F.desc("n"), "month")


def spend_summary(papers: DataFrame, unit: str = "0.08") -> DataFrame:
    """One row: what is done and what remains, by unit cost."""
    done = F.count_if(F.col("text_status") == "complete")
    u = F.lit(unit).cast("decimal(10,2)")
    return papers.agg(done.alias("done"), (F.count("*") - done).alias("remaining"), (done * u).alias("spent"), ((F.count("*") - done) * u).alias("to_spend"))


def over_daily_budget(costs: DataFrame, limit: float) -> DataFrame:
    """(day, cost) over the limit."""
    return costs.groupBy(F.to_date("at").alias("day")).agg(F.sum("cost").alias("cost")).filter(F.col("cost") > limit)


def keep_last(df: DataFrame, column: str, cutoff: Column, n: int, keep_invalid: bool = True) -> DataFrame:
    """Rows after the cutoff, then the n newest by seq."""
    return newer_than(df, column, cutoff, keep_invalid).orderBy(F.desc("seq")).limit(n)


def last_lines(logs: DataFrame, each: int = 10, n: int = 20) -> DataFrame:
    """The last lines of each file, of these the newest."""
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line_no")))
    return logs.withColumn("rn", place).filter(F.col("rn") <= each).orderBy(F.desc("modified"), F.desc("line_no"), "file").limit(n).drop("rn")


def failure_streaks(events: DataFrame, persistent: int = 2, transient: int = 5, by: str = "source") -> DataFrame:
    """Events (seq, kind) where a streak trips: kinds persistent, transient, ok; another kind ends a streak."""
    w = Window.partitionBy(by).orderBy("seq")
    step = (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit(""))).cast("int")
    islands = events.withColumn("__s", step).withColumn("island", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy(by, "island").orderBy("seq"))
    limit = F.when(F.col("kind") == "persistent", persistent).when(F.col("kind") == "transient", transient)
    return islands.withColumn("streak", streak).filter(F.col("streak") == limit).drop("__s", "island")


def accept_spaced(events: DataFrame, keys: list[str], seconds: int, order: str = "event_id") -> DataFrame:
    """Events of a key that come at least `seconds` after its last accepted one.

    What is accepted depends on what was accepted before, so each key is one fold in order; keys are requesters and
    papers, and a key's rows pass through in Arrow batches with one time kept (no group is held whole).
    """
    return _ordered_fold(events, keys, order, lambda: _Spaced(seconds))


def limit_rate(events: DataFrame, keys: list[str], seconds: int = 3600, most: int = 5, order: str = "event_id") -> DataFrame:
    """Of each key at most `most` events in a window that its first event opens and only a later event reopens."""
    return _ordered_fold(events, keys, order, lambda: _Limited(seconds, most))


class _Spaced:
    def __init__(self, seconds: int):
        self.seconds, self.last = seconds, None

    def accept(self, times: list[float]) -> list[bool]:
        keep, last, seconds = [], self.last, self.seconds
        for at in times:
            ok = last is None or at - last >= seconds
            last = at if ok else last
            keep.append(ok)
        self.last = last
        return keep


class _Limited:
    def __init__(self, seconds: int, most: int):
        self.seconds, self.most, self.reset, self.n = seconds, most, None, 0

    def accept(self, times: list[float]) -> list[bool]:
        keep = []
        for at in times:
            if self.reset is None or at > self.reset:
                self.reset, self.n = at + self.seconds, 0
            self.n += 1
            keep.append(self.n <= self.most)
        return keep


def _ordered_fold(events: DataFrame, keys: list[str], order: str, start) -> DataFrame:
    columns = events.columns
    stamped = events.withColumn("__s", F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6)
    # a key as one string, nulls apart from all values: where it changes is found on arrays
    stamped = stamped.withColumn("__key", F.to_json(F.struct(*keys)))
    dealt = stamped.repartition(*keys).sortWithinPartitions("__key", "__s", order)

    def run(batches):
        key, rule = None, None
        for pdf in batches:
            own, times = pdf["__key"].to_numpy(), pdf["__s"].tolist()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else [0]
            keep = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if rule is None or own[a] != key:
                    key, rule = own[a], start()
                keep += rule.accept(times[a:b])
            yield pdf.loc[keep, columns]

    return dealt.mapInPandas(run, events.schema)
