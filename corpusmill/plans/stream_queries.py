"""Streams over the event table, run until all that is there is taken: name -> (query, DuckDB oracle of the batch twin)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans import usage_queries
from corpusmill.sources.scratch import new_folder
from corpusmill.streaming import sinks, stateful

DAY = stateful.DAY
CHUNKS = 4  # micro-batches of the queries that need several


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a stream's path can't be one file
    return rows.withColumn("created_at", F.col("ts").cast("timestamp")).drop("ts")


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in CHUNKS micro-batches; each spans the whole time, so all but the first bring late rows."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("created_at", F.col("ts").cast("timestamp")).drop("ts")
    folder = new_folder(spark, "arriving")
    for chunk in range(CHUNKS):
        rows.filter(F.col("event_id") % CHUNKS == chunk).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


SLICE = 4_000_000  # rows of a micro-batch of in_order(), about


def in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in micro-batches of SLICE rows, each later than the one before: a key with many rows has no more than those in memory at once."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("created_at", F.col("ts").cast("timestamp")).drop("ts")
    parts = -(-rows.count() // SLICE)
    if parts <= 1:
        return events(spark, sf_dir)
    at = F.coalesce(F.unix_micros("created_at"), F.lit(1 << 62))  # as in an order by time, no time comes last
    edges = rows.select(at.alias("at")).approxQuantile("at", [k / parts for k in range(1, parts)], 0.05 / parts)
    part = F.size(F.filter(F.array(*[F.lit(int(e)) for e in edges]), lambda e: e < at))
    dealt, folder = new_folder(spark, "dealt"), new_folder(spark, "ordered")
    rows.withColumn("part", part).write.partitionBy("part").parquet(dealt)
    dealt_rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, part int").parquet(dealt)
    for k in range(parts):  # a stream takes files in the order in which they were written
        dealt_rows.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def taken(stream: DataFrame, label: str) -> DataFrame:
    """The stream's rows, after everything that is there has passed."""
    spark = stream.sparkSession
    sink = new_folder(spark, label)
    stateful.run_available(stream, f"{sink}/rows", f"{sink}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{sink}/rows")


def stream_dedup(spark, sf):
    rows = events(spark, sf).select("event_id", F.col("user_id").alias("paper_id"), F.col("event_type").alias("request_type"), "created_at")
    return taken(stateful.spaced(rows, ["paper_id", "request_type"], usage_queries.WINDOW), "dedup").select("event_id")


def stream_rate_limit(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", "created_at")
    return taken(stateful.rate_limited(rows, ["user_id"], 24 * 3600, 2), "rate").select("event_id")


def stream_breaker(spark, sf):
    kinds = F.when(F.col("event_type") == "error", "persistent").when(F.col("event_type") == "view", "transient").otherwise("ok")
    rows = events(spark, sf).select("event_id", F.col("user_id").alias("source"), kinds.alias("kind"), "created_at")
    return taken(stateful.breaker_trips(rows, "source", 2, 3), "breaker").select("event_id", "source", "kind")


def stream_alerts(spark, sf):
    """Alert groups that the first alert of a user opens for a day, once they are closed; critical alerts by themselves."""
    rows = events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("key"), (_k() % 4).alias("level"), "created_at")
    found = taken(stateful.alert_sessions(rows, DAY), "alerts")
    return found.select("key", "kind", "n", "level", F.unix_micros("start").alias("start_us"))


def stream_throttled(spark, sf):
    """Every event type's messages, at most one an hour."""
    rows = in_order(spark, sf).select("event_id", F.col("event_type").alias("key"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), "created_at")
    found = taken(stateful.throttled_messages(rows, 5, 3600), "throttled")
    return found.select("key", "n", "message", F.unix_micros("at").alias("at_us"))


def stream_new_events(spark, sf):
    """Events of users that aren't among the 20 last new ones of their event type."""
    rows = in_order(spark, sf).select("event_id", "event_type", "user_id", "created_at")
    return taken(stateful.new_events(rows, "user_id", "event_type", 20), "new").select("event_id")


def stream_budget(spark, sf):
    """Event types over the budget, as last emitted."""
    sink = new_folder(spark, "budget")
    rows = arriving(spark, sf).select(F.col("event_type").alias("bucket"))
    sinks.budget_alerts(rows, 100, sink, f"{sink}/state").awaitTermination()
    return sinks.emitted(spark, sink, "bucket string, n long").select("bucket", "n", "batch")


def stream_late(spark, sf):
    """How many events of each micro-batch come in time, and how many late, when half a month's delay is allowed."""
    sink = new_folder(spark, "late")
    rows = arriving(spark, sf).select("event_id", "created_at")
    sinks.split_late(rows, sink, f"{sink}/state", delay=dt.timedelta(days=15)).awaitTermination()
    kept = sinks.accepted(spark, sink, rows.schema).agg(F.lit(-1).alias("chunk"), F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    late = sinks.late(spark, sink, rows.schema).groupBy((F.col("event_id") % CHUNKS).cast("int").alias("chunk")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return kept.unionByName(late)


def stream_jobs(spark, sf):
    """Events as job events: every change of a job's status."""
    kind = F.element_at(F.array(*map(F.lit, ("claim", "complete", "fail", "flag", "reset", "claim", "fail"))), (_k() % 7 + 1).cast("int"))
    rows = events(spark, sf).select("event_id", F.col("user_id").alias("job"), kind.alias("event"), "created_at")
    found = taken(stateful.job_states(rows, stuck=DAY, keep=10 * DAY), "jobs")
    return found.select("job", F.unix_micros("at").alias("at_us"), "status", "attempts")


def kept_days(spark, sf):
    """The events of the last 10 days, of tables by day: older partitions aren't read."""
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("day", F.to_date(F.col("ts")))
    folder = new_folder(spark, "days")
    rows.select("event_id", "day").write.partitionBy("day").parquet(folder)
    last = rows.agg(F.max("day")).first()[0]
    found = stateful.within_days(spark.read.schema("event_id long, day date").parquet(folder), F.lit(last), 10)
    return found.groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def first_number(row: dict) -> dict:
    import re

    found = re.search(r"[0-9]{1,9}", row["text"] or "")
    if found is None:
        raise ValueError("no number")
    return {"number": int(found.group())}


def numbers_or_errors(spark, sf):
    """Every document's first number, or what went wrong."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return stateful.one_by_one(docs, first_number, "doc_id long, status string, error string, number long", "doc_id")


# event time in microseconds, in order; high: the watermark after the last micro-batch, in whole milliseconds
_ORDERED = """e AS (SELECT *, epoch_us(ts) AS t FROM events), high AS (SELECT (max(t) // 1000 - 600000) * 1000 AS w FROM e)"""

PLANS = {
    "stream_dedup": (stream_dedup, usage_queries.PLANS["accepted_requests"][1]),
    "stream_rate_limit": (stream_rate_limit, usage_queries.PLANS["rate_limited"][1]),
    "stream_breaker": (
        stream_breaker,
        """WITH k AS (SELECT user_id AS source, event_id, ts, CASE event_type WHEN 'error' THEN 'persistent' WHEN 'view' THEN 'transient' ELSE 'ok' END AS kind FROM events),
      s AS (SELECT *, CAST(kind <> coalesce(lag(kind) OVER (PARTITION BY source ORDER BY ts, event_id), '') AS INT) AS step FROM k), i AS (SELECT *, sum(step) OVER (PARTITION BY source ORDER BY ts, event_id) AS island FROM s),
      n AS (SELECT *, row_number() OVER (PARTITION BY source, island ORDER BY ts, event_id) AS streak FROM i) SELECT event_id, source, kind FROM n WHERE (kind = 'persistent' AND streak = 2) OR (kind = 'transient' AND streak = 3)""",
    ),
    "stream_alerts": (
        stream_alerts,
        f"""WITH RECURSIVE {_ORDERED}, a AS (SELECT CAST(user_id AS VARCHAR) AS key, t, CAST(json_extract_string(props, '$.k') AS INT) % 4 AS level FROM e),
      s AS (SELECT key, min(t) AS start FROM a WHERE level < 3 GROUP BY key
        UNION ALL SELECT s.key, (SELECT min(t) FROM a WHERE a.key = s.key AND level < 3 AND t >= s.start + 86400000000) FROM s WHERE s.start IS NOT NULL),
      g AS (SELECT key, start, lead(start) OVER (PARTITION BY key ORDER BY start) AS later FROM s WHERE start IS NOT NULL)
      SELECT g.key, 'group' AS kind, count(*) AS n, max(level) AS level, start AS start_us FROM g JOIN a ON a.key = g.key AND level < 3 AND t >= start AND t < start + 86400000000, high
        WHERE later IS NOT NULL OR start + 86400000000 <= w GROUP BY g.key, start
      UNION ALL SELECT key, 'critical', 1, level, t FROM a WHERE level >= 3""",
    ),
    "stream_throttled": (
        stream_throttled,
        f"""WITH RECURSIVE {_ORDERED}, m AS (SELECT event_type AS key, t, event_id, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS rn FROM e),
      f AS (SELECT key, t AS sent, rn AS upto, 1 AS n, rn - 1 AS done FROM m WHERE rn = 1
        UNION ALL SELECT key, CASE WHEN held > 0 THEN sent + 3600000000 ELSE next END, CASE WHEN held > 0 THEN upto + held ELSE upto + 1 END, CASE WHEN held > 0 THEN held ELSE 1 END, upto
        FROM (SELECT f.*, (SELECT count(*) FROM m WHERE m.key = f.key AND m.rn > f.upto AND m.t < f.sent + 3600000000) AS held,
          (SELECT min(t) FROM m WHERE m.key = f.key AND m.rn > f.upto) AS next FROM f) WHERE next IS NOT NULL)
      SELECT f.key, f.n, sent AS at_us, (SELECT string_agg('• event ' || event_id, chr(10) ORDER BY rn) FROM m WHERE m.key = f.key AND rn > done AND rn <= least(upto, done + 5))
        || CASE WHEN n > 5 THEN chr(10) || '(+' || (n - 5) || ' more)' ELSE '' END AS message
      FROM f, high WHERE sent <= w OR EXISTS (SELECT 1 FROM m WHERE m.key = f.key AND m.t >= f.sent)""",
    ),
    "stream_new_events": (
        stream_new_events,
        f"""WITH RECURSIVE {_ORDERED}, o AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS rn FROM e),
      r AS (SELECT event_type, rn, event_id, true AS new, [user_id] AS ring FROM o WHERE rn = 1
        UNION ALL SELECT o.event_type, o.rn, o.event_id, NOT list_contains(ring, user_id),
          CASE WHEN list_contains(ring, user_id) THEN ring WHEN len(ring) = 20 THEN list_append(ring[2:], user_id) ELSE list_append(ring, user_id) END
        FROM r JOIN o ON o.event_type = r.event_type AND o.rn = r.rn + 1)
      SELECT event_id FROM r WHERE new""",
    ),
    "stream_budget": (
        stream_budget,
        """WITH c AS (SELECT event_type AS bucket, CAST(event_id % 4 AS INT) AS batch, count(*) AS k FROM events GROUP BY ALL),
      n AS (SELECT bucket, batch, CAST(sum(k) OVER (PARTITION BY bucket ORDER BY batch) AS BIGINT) AS n FROM c) SELECT bucket, n, batch FROM n WHERE n > 100""",
    ),
    "stream_late": (
        stream_late,
        """WITH c AS (SELECT event_id, ts, CAST(event_id % 4 AS INT) AS chunk FROM events), h AS (SELECT chunk, max(ts) AS high FROM c GROUP BY chunk),
      l AS (SELECT c.*, coalesce(ts <= (SELECT max(high) FROM h WHERE h.chunk < c.chunk) - INTERVAL 15 DAY, false) AS late FROM c)
      SELECT CASE WHEN late THEN chunk ELSE -1 END AS chunk, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM l GROUP BY 1""",
    ),
    "stream_jobs": (
        stream_jobs,
        f"""WITH RECURSIVE {_ORDERED}, o AS (SELECT user_id AS job, t, ['claim', 'complete', 'fail', 'flag', 'reset', 'claim', 'fail'][CAST(json_extract_string(props, '$.k') AS INT) % 7 + 1] AS event,
        row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM e),
      r AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS rn, 'pending' AS status, 0 AS attempts, CAST(0 AS BIGINT) AS since, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS stuck_at, 0 AS had, false AS changed FROM o
        UNION ALL SELECT job, rn, CASE WHEN event = 'claim' AND s = 'pending' THEN 'in_progress' WHEN event = 'complete' AND s = 'in_progress' THEN 'completed' WHEN event = 'flag' AND s = 'in_progress' THEN 'qa_flagged'
          WHEN event = 'fail' AND s = 'in_progress' THEN CASE WHEN a + 1 >= 3 THEN 'failed' ELSE 'pending' END WHEN event = 'reset' AND s = 'failed' THEN 'pending' ELSE s END,
          CASE WHEN event = 'fail' AND s = 'in_progress' THEN a + 1 WHEN event = 'reset' AND s = 'failed' THEN 0 ELSE a END,
          CASE WHEN event = 'claim' AND s = 'pending' THEN t ELSE since END, t, stuck_at, had,
          (event = 'claim' AND s = 'pending') OR (event IN ('complete', 'flag', 'fail') AND s = 'in_progress') OR (event = 'reset' AND s = 'failed')
        FROM (SELECT o.job, o.rn, o.t, o.event, r.since, r.attempts AS had, CASE WHEN r.status = 'in_progress' AND o.t - r.since >= 86400000000 THEN r.since + 86400000000 END AS stuck_at,
          CASE WHEN coalesce(o.t - r.last >= 864000000000, false) OR (r.status = 'in_progress' AND o.t - r.since >= 86400000000) THEN 'pending' ELSE r.status END AS s,
          CASE WHEN coalesce(o.t - r.last >= 864000000000, false) THEN 0 ELSE r.attempts END AS a FROM r JOIN o ON o.job = r.job AND o.rn = r.rn + 1)),
      z AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY rn DESC) AS back FROM r)
      SELECT job, t AS at_us, status, attempts FROM (SELECT job, last AS t, status, attempts FROM r WHERE changed UNION ALL SELECT job, stuck_at, 'pending', had FROM r WHERE stuck_at IS NOT NULL
        UNION ALL SELECT job, since + 86400000000, 'pending', attempts FROM z, high WHERE back = 1 AND status = 'in_progress' AND since + 86400000000 <= w)""",
    ),
    "kept_days": (
        kept_days,
        """WITH d AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events) SELECT day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM d
      WHERE day > (SELECT max(day) FROM d) - 10 GROUP BY day""",
    ),
    "numbers_or_errors": (
        numbers_or_errors,
        """WITH n AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '[0-9]{1,9}') AS n FROM documents)
      SELECT doc_id, CASE WHEN n = '' THEN 'error' ELSE 'ok' END AS status, CASE WHEN n = '' THEN 'no number' END AS error, CAST(nullif(n, '') AS BIGINT) AS number FROM n""",
    ),
}
