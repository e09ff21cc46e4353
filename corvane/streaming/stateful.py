"""Streams whose state is more than an aggregate: admission under quotas, presence of connections.

Both need the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.quota import DAY, DECISION, Counters, Limits

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Name of a connection that gives none: a fixed value.
NO_NAME = "協作者"


class _Admission(StatefulProcessor):
    """Requests wait until the watermark has passed them, then are decided in order of time."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id string, tokens long")
        self.used = handle.getValueState("used", "minute long, requests long, tokens long, day long, day_requests long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for b in rows:
            new = [(int(us), str(i), 0 if pd.isna(n) else int(n)) for us, i, n in zip(b["us"], b["id"], b["tokens"])]
            if new:
                self.waiting.appendList(new)
                least = min([x[0] for x in new] + ([least] if least is not None else []))
        if least is not None:
            self.handle.registerTimer(least // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [x for x in held if x[0] // 1000 < passed], [x for x in held if x[0] // 1000 >= passed]
        used = Counters(*self.used.get(), limits=self.limits) if self.used.exists() else Counters(limits=self.limits)
        out = [(*key, i, us, n, *used.admit(us // 1_000_000, n)) for us, i, n in due]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif held:
            self.waiting.clear()
        if due:
            self.used.update((used.minute, used.requests, used.tokens, used.day, used.day_requests))
            self.handle.registerTimer((used.day + 1) * DAY * 1000)
        elif not held and self.used.exists() and (used.day + 1) * DAY * 1000 <= passed:
            self.used.clear()  # the day is over
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "us", "tokens", "allowed", "wait_seconds", "reason"])

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, key: str, ts: str, tie: str, tokens: str, limits: Limits, late: str = "2 minutes") -> DataFrame:
    """Requests decided as operators.quota.admissions decides a table's, in whatever order they
    come, as long as they are no later than late (J03, J04); later ones are dropped by the watermark.

    A request is put out once the watermark has passed it. State: requests that wait, and five
    counters for each key, which a timer clears after the key's last day. tie: a string column."""
    rows = requests.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.col(tie).cast("string").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tokens).cast("long").alias("tokens"), F.col(ts))
    kind = "key string, id string, us long, tokens long, " + DECISION
    return rows.groupBy("key").transformWithStateInPandas(_Admission(limits), kind, "append", "EventTime")


CHANGE = "sid string, pid string, user_id string, name string, since long, us long, online boolean"


class _Presence(StatefulProcessor):
    """One connection: where it is, since when, and when it was heard of last."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("at", "pid string, user_id string, name string, since long, us long, online boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = tuple(self.state.get()) if self.state.exists() else None
        now = was
        events = pd.concat(list(rows)).sort_values(["us", "action"])
        for pid, user, name, us, action in zip(*(events[c] for c in ("pid", "user_id", "name", "us", "action"))):
            us, live = int(us), now is not None and now[5]
            if now is not None and us < now[4]:
                continue  # older than what is known
            if action == "enter" and pid:
                since = now[3] if live else us
                now = (pid, user, name or NO_NAME, since, us, True)
            elif action == "leave" and now is not None:
                now = (*now[:4], us, False)
            elif live:
                now = (*now[:4], us, True)
        if now is not None and now != was:
            self.state.update(now)
            self.handle.registerTimer(now[4] // 1000 + self.idle_ms)
            # Heartbeats alone are no change; a move leaves the old project first.
            if was is not None and was[5] and now[5] and was[0] != now[0]:
                yield pd.DataFrame([(*key, *was[:4], now[4], False), (*key, *now)], columns=[c.split()[0] for c in CHANGE.split(", ")])
            elif (was is None and now[5]) or (was is not None and (was[5] != now[5] or was[:3] != now[:3])):
                yield pd.DataFrame([(*key, *now)], columns=[c.split()[0] for c in CHANGE.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        now = tuple(self.state.get())
        end = now[4] // 1000 + self.idle_ms
        if end > timerValues.getCurrentWatermarkInMs():
            return  # heard of since; a later timer is set
        self.state.clear()
        if now[5]:
            yield pd.DataFrame([(*key, *now[:4], end * 1000, False)], columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def presence_stream(events: DataFrame, ts: str = "ts", idle_seconds: int = 3600, late: str = "10 seconds") -> DataFrame:
    """Changes of connections (J10): sid, pid, user_id, name, since, us, online.

    events: sid, pid, user_id, name, action (enter, leave, anything else is a sign of life), ts.
    Entering again moves a connection to another project and keeps its place in line. A connection
    that is not heard of for idle_seconds is put out as gone and its state is dropped, so state
    holds live connections only. Rows without sid, and entries without pid, are ignored."""
    rows = events.where("sid IS NOT NULL AND sid <> ''").withWatermark(ts, late)
    rows = rows.select(F.col("sid").cast("string").alias("sid"), F.coalesce(F.col("pid").cast("string"), F.lit("")).alias("pid"), F.col("user_id").cast("string").alias("user_id"), "name", "action", F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(ts))
    return rows.groupBy("sid").transformWithStateInPandas(_Presence(idle_seconds * 1000), CHANGE, "append", "EventTime")


def online_users(changes: DataFrame) -> DataFrame:
    """(pid, user_id, name, n): who is online in each project by the changes so far, once for each
    user under the name of the first connection, in order of name (E13)."""
    last = Window.partitionBy("sid").orderBy(F.desc("us"), F.desc("online"))
    live = changes.withColumn("k", F.row_number().over(last)).where("k = 1 AND online")
    users = live.groupBy("pid", "user_id").agg(F.min_by("name", F.struct("since", "sid")).alias("name"))
    return users.withColumn("n", F.row_number().over(Window.partitionBy("pid").orderBy("name", "user_id")))
