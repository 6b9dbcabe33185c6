"""Keyed streams with state that ends: ordered folds by key, event-time timers that close or forget, bounded memories.

Inputs are streams with created_at (timestamp) and event_id; keys are columns. In a micro-batch a key's rows are taken in
(created_at, event_id) order, so streams whose files come in that order give what the batch operators give. Every fold says when a key's
state no longer matters; an event-time timer then closes it (which may emit a row) and the state is gone. Rows at or behind the watermark
come too late and are dropped (Spark's own filter is a micro-batch behind the timers): split_late() in corpusmill.streaming.sinks keeps
and counts them first, by the same rule.

State lives in RocksDB (use_rocksdb()), as value, list and map states need it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

DAY = 24 * 3600
DELAY = "10 minutes"
PARTS = 4096  # groups of keys that are folded together; it is in the checkpoint, as the state is by group


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _seconds(pdf: pd.DataFrame) -> pd.Series:
    return pdf["created_at"].astype("datetime64[us]").astype("int64") / 1e6


def _times(seconds: list[float]) -> pd.Series:
    return pd.Series([round(s * 1e6) for s in seconds], dtype="int64").astype("datetime64[us]")


def _in_time(frames: Iterator[pd.DataFrame], timers) -> pd.DataFrame:
    """A key's rows of one micro-batch beyond the watermark, in order; the caller bounds them by maxFilesPerTrigger on the source."""
    rows = pd.concat(list(frames)).sort_values(["created_at", "event_id"], kind="stable")
    return rows[_seconds(rows) * 1000 > timers.getCurrentWatermarkInMs()]


class _Fold(StatefulProcessor):
    """Folds of many keys: a group holds the keys of one hash, their states as a map and one timer, at the soonest time a state ends.

    step(key, (seconds, row) in order, state tuple or None) -> (output rows, new state or None, seconds of its end or None);
    close(key, state) -> the same, at its end. A group of a single key would cost a data frame and half a dozen messages to the JVM a key;
    here a key's state is read, written and removed by a message each.
    """

    def __init__(self, out: T.StructType, times: list[str], schema: str, step, close=None):
        self.names, self.times, self.schema, self.step, self.close_state = out.names, times, schema, step, close

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", "key string", f"{self.schema}, ends double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _in_time(rows, timerValues)
        if not len(rows):
            return
        dealt: dict[str, list] = {}
        for at, row in zip(_seconds(rows).tolist(), rows.itertuples(index=False), strict=True):
            dealt.setdefault(row.fold_key, []).append((at, row))
        known = self.state.exists()
        out, due = [], list(self.handle.listTimers()) if known else []
        soonest = min(due, default=None)
        for own, timed in dealt.items():
            old = self.state.getValue((own,)) if known else None
            found, new, ends = self.step(_key(own), timed, old and tuple(old)[:-1])
            out += found
            soonest = self._keep(own, new, ends, old is not None, soonest)
        self._wake(soonest, due)
        yield from self._rows(out)

    def _keep(self, own: str, new, ends, had: bool, soonest):
        """The key's new state; the soonest timer, with it."""
        if new is not None:
            self.state.updateValue((own,), (*new, ends))
        elif had:
            self.state.removeKey((own,))
        at = None if new is None or ends is None else math.ceil(ends * 1000)
        return min((x for x in (soonest, at) if x is not None), default=None)

    def _wake(self, soonest, due: list[int]) -> None:
        for at in due:
            if at != soonest:
                self.handle.deleteTimer(at)
        if soonest is not None and soonest not in due:
            self.handle.registerTimer(soonest)

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            pdf = pd.DataFrame([tuple(row)[: len(self.names)] for row in out], columns=self.names)
            yield pdf.assign(**{c: _times(pdf[c].tolist()) for c in self.times})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out, over, soonest = timerValues.getCurrentWatermarkInMs(), [], [], None
        held = [(own, tuple(value)) for (own,), value in self.state.iterator()]
        for own, (*state, ends) in held:
            at = None if ends is None else math.ceil(ends * 1000)
            if at is None or at > mark:
                soonest = min((x for x in (soonest, at) if x is not None), default=None)
                continue
            found, new, ends = self.close_state(_key(own), tuple(state)) if self.close_state else ([], None, None)
            out += found
            if new is None:
                over.append(own)
            else:
                soonest = self._keep(own, new, ends, True, soonest)
        if len(over) == len(held):
            self.state.clear()
        else:
            for own in over:
                self.state.removeKey((own,))
        self._wake(soonest, [])
        yield from self._rows(out)

    def close(self) -> None:
        pass


def _key(own: str) -> tuple:
    return tuple(json.loads(own).values())


def _fold(stream: DataFrame, keys: list[str], out: T.StructType | str, state: str, step, late: str, close=None, times: tuple[str, ...] = ()) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    out = T.StructType.fromDDL(out) if isinstance(out, str) else out
    rows = stream.withWatermark("created_at", late).withColumn("fold_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    dealt = rows.withColumn("fold_part", F.pmod(F.xxhash64("fold_key"), F.lit(PARTS))).groupBy("fold_part")
    return dealt.transformWithStateInPandas(_Fold(out, list(times), state, step, close), out, "append", "EventTime")


def spaced(stream: DataFrame, keys: list[str], seconds: int, late: str = DELAY) -> DataFrame:
    """As usage.accept_spaced(); state: the last accepted time, until `seconds` later. dropDuplicatesWithinWatermark would not restart at accepted rows."""

    def step(key, rows, state):
        last = state[0] if state else None
        keep = []
        for at, row in rows:
            if last is None or at - last >= seconds:
                last = at
                keep.append(row)
        return keep, (last,), last + seconds

    return _fold(stream, keys, stream.schema, "last double", step, late)


def rate_limited(stream: DataFrame, keys: list[str], seconds: int = 3600, most: int = 5, late: str = DELAY) -> DataFrame:
    """As usage.limit_rate(); state: when the window ends and how many came, until the window ends."""

    def step(key, rows, state):
        reset, n = state or (None, 0)
        keep = []
        for at, row in rows:
            if reset is None or at > reset:
                reset, n = at + seconds, 0
            n += 1
            if n <= most:
                keep.append(row)
        return keep, (reset, n), reset + 0.001

    return _fold(stream, keys, stream.schema, "reset double, n long", step, late)


def breaker_trips(stream: DataFrame, by: str = "source", persistent: int = 2, transient: int = 5, idle: int = 30 * DAY, late: str = DELAY) -> DataFrame:
    """As usage.failure_streaks(), but that `idle` seconds without an event end a streak; state: its kind, length and last time."""

    def step(key, rows, state):
        kind, n, last = state or ("", 0, None)
        keep = []
        for at, row in rows:
            now = row.kind
            same = now == kind and (last is None or at - last < idle)
            kind, n, last = (kind, n + 1, at) if same else (now, 1, at)
            if (now == "persistent" and n == persistent) or (now == "transient" and n == transient):
                keep.append(row)
        return keep, (kind, n, last), last + idle

    return _fold(stream, [by], stream.schema, "kind string, n long, last double", step, late)


def alert_sessions(stream: DataFrame, seconds: int = 60, late: str = DELAY) -> DataFrame:
    """Groups of a key's alerts that the first of each opens for `seconds`; those of level 3 or more go out by themselves, at once.

    (key, kind, start, n, level). A group goes out when an alert comes after its end or the watermark has passed it, whichever is first:
    every alert is in one group once the watermark is past it.
    """
    def row_of(key, kind, start, n, level):
        return key[0], kind, start, n, level

    def step(key, rows, state):
        start, n, level = state or (None, 0, 0)
        out = []
        for at, row in rows:
            now = int(row.level)
            if now >= 3:
                out.append(row_of(key, "critical", at, 1, now))
                continue
            if start is not None and at - start >= seconds:
                out.append(row_of(key, "group", start, n, level))
                start, n, level = None, 0, 0
            start = at if start is None else start
            n, level = n + 1, max(level, now)
        return out, None if start is None else (start, n, level), None if start is None else start + seconds

    def close(key, state):
        return [row_of(key, "group", *state)], None, None

    return _fold(stream, ["key"], "key string, kind string, start timestamp, n long, level int", "start double, n long, level int", step, late, close, ("start",))


def alert_windows(stream: DataFrame, window: str = "60 seconds", late: str = DELAY) -> DataFrame:
    """X4, approximated without Python: tumbling windows; (key, window, n, level)."""
    return stream.withWatermark("created_at", late).groupBy("key", F.window("created_at", window)).agg(F.count("*").alias("n"), F.max("level").alias("level"))


class _Throttle(StatefulProcessor):
    """When a key last sent, how many messages wait and, as a list state, the first of them."""

    def __init__(self, shown: int, seconds: int):
        self.shown, self.seconds = shown, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "last double, n long")
        self.waiting = handle.getListState("waiting", "message string")

    def _line(self, key, at, n, lines):
        more = f"\n(+{n - self.shown} more)" if n > self.shown else ""
        return key[0], at, n, "\n".join(f"• {m}" for m in lines) + more

    def _rows(self, out):
        pdf = pd.DataFrame(out, columns=["key", "at", "n", "message"])
        pdf["at"] = _times(list(pdf["at"]))
        return pdf

    def handleInputRows(self, key, rows, timerValues):
        rows = _in_time(rows, timerValues)
        if not len(rows):
            return
        last, n = self.sent.get() if self.sent.exists() else (None, 0)
        lines = [m for (m,) in self.waiting.get()] if n else []
        out = []
        for at, message in zip(_seconds(rows), rows["message"], strict=True):
            if n and at - last >= self.seconds:  # what waited was due before this one came
                last += self.seconds
                out.append(self._line(key, last, n, lines))
                n, lines = 0, []
            if last is None or at - last >= self.seconds:
                last = at
                out.append(self._line(key, at, 1, [message]))
            else:
                n += 1
                lines = [*lines, message] if len(lines) < self.shown else lines
        self._keep(last, n, lines)
        yield self._rows(out)

    def _keep(self, last, n, lines):
        self.sent.update((last, n))
        if lines:
            self.waiting.put([(m,) for m in lines])
        else:
            self.waiting.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(math.ceil((last + self.seconds) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, n = self.sent.get()
        if not n:  # nothing came since: the next message goes at once, as for a new key
            self.sent.clear()
            return
        lines = [m for (m,) in self.waiting.get()]
        self._keep(last + self.seconds, 0, [])
        yield self._rows([self._line(key, last + self.seconds, n, lines)])

    def close(self) -> None:
        pass


def throttled_messages(stream: DataFrame, shown: int = 5, seconds: int = 900, late: str = DELAY) -> DataFrame:
    """(key, at, n, message): a key's messages, sent at once if nothing was sent for `seconds`, else together when that time is over.

    A message shows the first lines and how many more there are; state holds no more than those.
    """
    use_rocksdb(stream.sparkSession)
    dealt = stream.withWatermark("created_at", late).groupBy("key")
    return dealt.transformWithStateInPandas(_Throttle(shown, seconds), "key string, at timestamp, n long, message string", "append", "EventTime")


def job_states(stream: DataFrame, most: int = 3, stuck: int = 7200, keep: int = 30 * DAY, late: str = DELAY) -> DataFrame:
    """Job events (job, event) to states: claim, complete, flag, fail, reset.

    A claim takes a pending job; the third failure is final; a claim older than `stuck` seconds goes back to pending by timer or
    before the next event; reset reopens a failed job. A job is forgotten `keep` seconds after its last event.
    """
    def row_of(key, at, status, attempts):
        return key[0], at, status, attempts

    def step(key, rows, state):
        status, attempts, since, last = state or ("pending", 0, 0.0, None)
        out = []
        for at, row in rows:
            event = row.event
            if status == "in_progress" and at - since >= stuck:
                status = "pending"
                out.append(row_of(key, since + stuck, status, attempts))
            if last is not None and at - last >= keep:
                status, attempts = "pending", 0
            last = at
            if event == "claim" and status == "pending":
                status, since = "in_progress", at
            elif event == "complete" and status == "in_progress":
                status = "completed"
            elif event == "flag" and status == "in_progress":
                status = "qa_flagged"
            elif event == "fail" and status == "in_progress":
                attempts += 1
                status = "failed" if attempts >= most else "pending"
            elif event == "reset" and status == "failed":
                status, attempts = "pending", 0
            else:
                continue
            out.append(row_of(key, at, status, attempts))
        return out, (status, attempts, since, last), since + stuck if status == "in_progress" else last + keep

    def close(key, state):
        status, attempts, since, last = state
        if status != "in_progress":
            return [], None, None
        return [row_of(key, since + stuck, "pending", attempts)], ("pending", attempts, since, last), last + keep

    out = "job long, at timestamp, status string, attempts int"
    return _fold(stream, ["job"], out, "status string, attempts int, since double, last double", step, late, close, ("at",))


class _Seen(StatefulProcessor):
    """The last `memory` ids of a key, as a map from id to its number."""

    def __init__(self, id_col: str, memory: int):
        self.id_col, self.memory = id_col, memory

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "n long")
        self.ring = handle.getMapState("ring", "id string", "n long")

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows)).sort_values(["created_at", "event_id"], kind="stable")
        n = self.next.get()[0] if self.next.exists() else 0
        before = {k[0]: v[0] for k, v in self.ring.iterator()} if n else {}  # `memory` ids at most
        held = dict(sorted(before.items(), key=lambda x: x[1]))  # oldest first
        keep = []
        for id_ in map(str, rows[self.id_col]):
            new = id_ not in held
            keep.append(new)
            if new:
                held[id_] = n
                n += 1
                if len(held) > self.memory:
                    del held[next(iter(held))]
        for id_ in before.keys() - held.keys():
            self.ring.removeKey((id_,))
        for id_, at in held.items():
            if before.get(id_) != at:
                self.ring.updateValue((id_,), (at,))
        self.next.update((n,))
        yield rows[keep]

    def close(self) -> None:
        pass


def new_events(stream: DataFrame, id_col: str, by: str, memory: int = 200) -> DataFrame:
    """Events whose id is none of the last `memory` new ones of their key, oldest first; a seen id doesn't renew its place."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(by).transformWithStateInPandas(_Seen(id_col, memory), stream.schema, "append", "None")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there, resumed from the checkpoint."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within_days(df: DataFrame, as_of, days: int, column: str = "day") -> DataFrame:
    """The day partitions that are kept; others aren't read."""
    return df.filter(F.col(column) > F.date_sub(as_of, days))


def one_by_one(df: DataFrame, work, schema: str, key: str = "id") -> DataFrame:
    """X11: work(row) -> dict for each row; an exception makes a row with status "error". schema has key, status, error."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({key: row[key], "status": "ok", "error": None, **work(row)})
                except Exception as error:  # the row says what went wrong
                    out.append({key: row[key], "status": "error", "error": str(error)})
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)
