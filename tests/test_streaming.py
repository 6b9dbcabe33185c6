"""Streams against their batch twins, over files and in several micro-batches."""

from __future__ import annotations

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import usage
from corpusmill.streaming import sinks, stateful

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, key string, kind string, level int, message string, created_at timestamp"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    at, out = START, []
    for i in range(300):
        at += dt.timedelta(seconds=rng.randrange(1, 40))
        out.append((i, rng.choice("abc"), rng.choice(["persistent", "transient", "ok"]), rng.randrange(4), f"m{i % 5}", at))
    return out


@pytest.fixture
def source(spark, rows, tmp_path):
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), str(tmp_path)


def streamed(spark, path, build):
    stream = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    stateful.run_available(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def keys(df):
    return sorted(r["event_id"] for r in df.collect())


def test_spaced(spark, source):
    batch, path = source
    assert keys(streamed(spark, path, lambda s: stateful.spaced(s, ["key"], 60))) == keys(usage.accept_spaced(batch, ["key"], 60))


def test_rate_limit(spark, source):
    batch, path = source
    assert keys(streamed(spark, path, lambda s: stateful.rate_limited(s, ["key"], 600, 5))) == keys(usage.limit_rate(batch, ["key"], 600, 5))


def test_breaker(spark, source):
    batch, path = source
    want = usage.failure_streaks(batch.select(F.col("key").alias("source"), F.col("event_id").alias("seq"), "kind"), 2, 3)
    got = streamed(spark, path, lambda s: stateful.breaker_trips(s, "key", 2, 3))
    assert keys(got) == sorted(r["seq"] for r in want.collect())


def sessions(rows, seconds, high):
    """Every alert is in one group; those whose end is past `high` are still open."""
    out, held = [], {}
    for _, key, _, level, _, at in rows:
        now = (at - START).total_seconds()
        if level >= 3:
            out.append((key, "critical", now, 1))
            continue
        if key in held and now - held[key][0] >= seconds:
            out.append((key, "group", *held.pop(key)))
        first, n = held.get(key, (now, 0))
        held[key] = (first, n + 1)
    return sorted(out + [(key, "group", first, n) for key, (first, n) in held.items() if first + seconds <= high])


def since(at):
    return (at - START).total_seconds()


def test_alert_sessions(spark, source, rows):
    _, path = source
    got = streamed(spark, path, lambda s: stateful.alert_sessions(s, 60, "0 seconds"))
    assert sorted((r["key"], r["kind"], since(r["start"]), r["n"]) for r in got.collect()) == sessions(rows, 60, since(rows[-1][5]))


def later(rows, seconds):
    """One more event of another key, so late that the watermark passes everything before it."""
    return (10_000, "z", "ok", 0, "end", rows[-1][5] + dt.timedelta(seconds=seconds))


def states(spark, path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{path}/state").count()


@pytest.mark.parametrize(
    ("build", "name", "ends"),  # a waiting message or a stuck job is dealt with first and forgotten later: two steps
    [
        (lambda s: stateful.spaced(s, ["key"], 60, "0 seconds"), "state", [20_000]),
        (lambda s: stateful.rate_limited(s, ["key"], 600, 5, "0 seconds"), "state", [20_000]),
        (lambda s: stateful.breaker_trips(s, "key", 2, 3, 3600, "0 seconds"), "state", [20_000]),
        (lambda s: stateful.alert_sessions(s, 60, "0 seconds"), "state", [20_000]),
        (lambda s: stateful.throttled_messages(s, 2, 300, "0 seconds"), "sent", [20_000, 60_000]),
        (lambda s: stateful.job_states(s.withColumn("job", F.ascii("key").cast("long")).withColumn("event", F.lit("claim")), keep=9000, late="0 seconds"), "state", [20_000, 60_000]),
    ],
    ids=["spaced", "rate", "breaker", "alerts", "throttle", "jobs"],
)
def test_state_ends(spark, source, rows, build, name, ends):
    _, path = source
    streamed(spark, path, build)
    assert states(spark, path, name) > 0
    for ahead in ends:
        spark.createDataFrame([later(rows, ahead)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        streamed(spark, path, build)
    assert states(spark, path, name) == 1  # the last event's own key


def test_every_alert_is_in_one_group(spark, source, rows):
    _, path = source
    spark.createDataFrame([later(rows, 3600)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    got = streamed(spark, path, lambda s: stateful.alert_sessions(s, 60, "0 seconds")).agg(F.sum("n")).first()[0]
    assert got == len(rows)


def test_new_events_forget_the_oldest(spark, source, rows):
    _, path = source
    held, want = {}, []
    for id_, key, _, _, message, _ in rows:
        ring = held.setdefault(key, [])
        if message not in ring:
            want.append(id_)
            ring.append(message)
            del ring[:-3]
    assert len(want) > 5 * len(held)  # ids came back after they were forgotten
    assert keys(streamed(spark, path, lambda s: stateful.new_events(s, "message", "key", 3))) == sorted(want)


def test_throttled_messages(spark, source, rows):
    _, path = source
    want, high = [], since(rows[-1][5])
    for key in "abc":
        last, waiting = None, []
        for _, k, _, _, message, at in rows:
            if k != key:
                continue
            now = since(at)
            if waiting and now - last >= 300:
                last += 300
                want.append((key, last, len(waiting), waiting[:2]))
                waiting = []
            if last is None or now - last >= 300:
                last = now
                want.append((key, now, 1, [message]))
            else:
                waiting.append(message)
        if waiting and last + 300 <= high:
            want.append((key, last + 300, len(waiting), waiting[:2]))
    text = lambda n, lines: "\n".join(f"• {m}" for m in lines) + (f"\n(+{n - 2} more)" if n > 2 else "")
    got = streamed(spark, path, lambda s: stateful.throttled_messages(s, 2, 300, "0 seconds")).collect()
    assert sorted((r["key"], since(r["at"]), r["n"], r["message"]) for r in got) == sorted((k, at, n, text(n, lines)) for k, at, n, lines in want)


def test_windows_close_behind_the_watermark(spark, source):
    batch, path = source
    closed = streamed(spark, path, lambda s: stateful.alert_windows(s, "5 minutes", "0 seconds"))
    want = batch.groupBy("key", F.window("created_at", "5 minutes")).count().filter(F.col("window.end") <= batch.agg(F.max("created_at")).first()[0])
    assert closed.count() == want.count() > 0


def live(spark, path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").select(F.col("key").alias("bucket"))
    sinks.budget_alerts(stream, 20, path, f"{path}/state").awaitTermination()
    return sorted((r["batch"], r["bucket"], r["n"]) for r in sinks.emitted(spark, path, "bucket string, n long").collect())


def test_only_changed_snapshots_are_emitted(spark, source, rows):
    _, path = source
    want, n, last = [], dict.fromkeys("abc", 0), {}
    for batch in range(3):
        for r in rows[batch * 100 : batch * 100 + 100]:
            n[r[1]] += 1
        for key in "abc":
            if n[key] > 20 and last.get(key) != n[key]:
                want.append((batch, key, n[key]))
                last[key] = n[key]
    assert live(spark, path) == sorted(want)


def test_a_replayed_batch_emits_the_same(spark, source):
    _, path = source
    first = live(spark, path)
    # as if the run had ended between the sink's write and the commit of the last batch
    for name in ("2", ".2.crc"):
        os.remove(f"{path}/state/commits/{name}")
    assert live(spark, path) == first


def test_late_rows_are_kept_and_counted(spark, rows, tmp_path):
    path = str(tmp_path)
    order = rows[:100] + rows[150:250] + rows[100:150] + rows[250:]
    for a, b in ((0, 100), (100, 200), (200, 300)):
        spark.createDataFrame(order[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    sinks.split_late(stream, f"{path}/out", f"{path}/marks", delay=dt.timedelta(seconds=300)).awaitTermination()
    cut = rows[249][5] - dt.timedelta(seconds=300)
    want = sorted(r[0] for r in rows[100:150] if r[5] <= cut)
    late = sinks.late(spark, f"{path}/out", stream.schema)
    assert want and keys(late) == want and {r["batch"] for r in late.collect()} == {2}
    kept = sinks.accepted(spark, f"{path}/out", stream.schema)
    assert keys(kept) == sorted(set(range(300)) - set(want))
    # the watermark drops the same rows
    out = streamed(spark, path, lambda s: stateful.spaced(s, ["event_id"], 1, "300 seconds"))
    assert keys(out) == keys(kept)


def test_jobs_fail_for_good_at_the_third_time(spark, tmp_path):
    events = ["claim", "fail", "claim", "fail", "complete", "claim", "fail", "claim", "reset", "claim", "check", "check", "claim", "complete"]
    times = [*range(0, 110, 10), 10_000, 10_010, 10_020]
    made = [(i, 1, e, START + dt.timedelta(seconds=t)) for i, (e, t) in enumerate(zip(events, times, strict=True))]
    schema = "event_id long, job long, event string, created_at timestamp"
    spark.createDataFrame(made, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.job_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stateful.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = [r["status"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
    assert got == ["in_progress", "pending", "in_progress", "pending", "in_progress", "failed", "pending", "in_progress", "pending", "in_progress", "completed"]


def test_resume_takes_only_what_is_new(spark, source, rows):
    _, path = source
    assert streamed(spark, path, lambda s: s).count() == 300
    spark.createDataFrame(rows[:7], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    assert streamed(spark, path, lambda s: s).count() == 307


def test_one_by_one_keeps_going(spark):
    def work(row):
        if row["id"] == 2:
            raise ValueError("no")
        return {"out": row["id"] * 10}

    got = stateful.one_by_one(spark.range(1, 4), work, "id long, status string, error string, out long").collect()
    assert sorted((r["id"], r["status"], r["error"]) for r in got) == [(1, "ok", None), (2, "error", "no"), (3, "ok", None)]


class Told:
    """A handle and its map state, which count what they are asked."""

    def __init__(self):
        self.held, self.timers, self.asked, self.mark = {}, [], [], 0

    def getMapState(self, name, key, value):
        return self

    def exists(self):
        return bool(self.held)

    def getValue(self, key):
        self.asked.append("get")
        return self.held.get(key)

    def updateValue(self, key, value):
        self.asked.append("update")
        self.held[key] = value

    def removeKey(self, key):
        self.asked.append("remove")
        del self.held[key]

    def iterator(self):
        return iter(self.held.items())

    def clear(self):
        self.asked.append("clear")
        self.held = {}

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.asked.append("register")
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_keys_of_a_group_share_a_timer_and_ask_for_little():
    step = lambda key, rows, state: ([r for _, r in rows], (rows[-1][0],), rows[-1][0] + 60)
    fold = stateful._Fold(T.StructType.fromDDL("event_id long, created_at timestamp"), [], "last double", step)
    told = Told()
    fold.init(told)

    def given(rows):
        made = [(i, pd.Timestamp(START + dt.timedelta(seconds=s)) if s is not None else pd.NaT, f'{{"k":{k}}}') for i, k, s in rows]
        return [e for pdf in fold.handleInputRows((0,), iter([pd.DataFrame(made, columns=["event_id", "created_at", "fold_key"])]), told) for e in pdf["event_id"]]

    assert given([(0, 1, 30), (1, 2, 20), (2, 1, 10), (3, 3, None)]) == [2, 0, 1]
    base = round(START.replace(tzinfo=dt.UTC).timestamp() * 1000)
    assert told.asked == ["update", "update", "register"] and told.timers == [base + 80_000]
    assert given([(4, 2, 100)]) == [4] and told.asked[3:] == ["get", "update"]
    told.mark, told.timers = base + 100_000, []
    assert list(fold.handleExpiredTimer((0,), told, None)) == [] and set(told.held) == {('{"k":2}',)} and told.timers == [base + 160_000]
    told.mark, told.timers = base + 160_000, []
    assert list(fold.handleExpiredTimer((0,), told, None)) == [] and not told.held and not told.timers
