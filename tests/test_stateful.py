"""Admission and presence: streams against tables and plain loops, with rows out of order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.quota import Counters, Limits, admissions
from corvane.streaming.stateful import ROCKSDB, admission_stream, online_users, presence_stream

START = dt.datetime(2024, 3, 1)
KIND = "user string, id string, ts timestamp, tokens long"
LIMITS = Limits(3, 100, 12, 1)


def requests(seed, n=400):
    r = random.Random(seed)
    # A few keys over two days, in bursts that meet every limit.
    return [(r.choice("abc"), f"r{i:04d}", START + dt.timedelta(minutes=r.choice([0, 1, 2, 600, 601, 1439, 1440, 2000]), seconds=r.randint(0, 59), microseconds=r.randint(0, 3)), r.choice([None, 0, 10, 40, 90])) for i in range(n)]


def plain(rows, limits):
    used, out = {}, {}
    for user, i, ts, tokens in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        s = int((ts - dt.datetime(1970, 1, 1)).total_seconds())
        n = max(tokens or 0, limits.least_cost)
        m, t, d = (user, "m", s // 60), (user, "t", s // 60), (user, "d", s // 86400)
        wait, reason = max(1, 60 - s % 60), None
        if used.get(m, 0) + 1 > limits.requests_a_minute > 0:
            reason = "rpm_limit"
        elif used.get(t, 0) + n > limits.tokens_a_minute > 0:
            reason = "tpm_limit"
        elif used.get(d, 0) + 1 > limits.requests_a_day > 0:
            reason, wait = "rpd_limit", max(60, 86400 - s % 86400)
        else:
            for k, x in ((m, 1), (t, n), (d, 1)):
                used[k] = used.get(k, 0) + x
        out[i] = (reason is None, float(wait) if reason else 0.0, reason or "ok")
    return out


@pytest.mark.parametrize("limits", [LIMITS, Limits(0, 120, 0), Limits(0, 0, 5), Limits(2, 0, 0)])
def test_table_equals_a_plain_loop(spark, limits):
    rows = requests(1)
    got = admissions(spark.createDataFrame(rows, KIND).withColumn("reason", F.lit("old")), "user", "ts", "id", "tokens", limits)
    assert {r.id: (r.allowed, r.wait_seconds, r.reason) for r in got.collect()} == plain(rows, limits)
    assert got.columns == ["user", "id", "ts", "tokens", "allowed", "wait_seconds", "reason"]


def test_no_limits_no_time_and_no_rows(spark):
    free = admissions(spark.createDataFrame(requests(2, 50), KIND), "user", "ts", "id", "tokens", Limits())
    assert {(r.allowed, r.reason) for r in free.collect()} == {(True, "ok")}
    none = spark.createDataFrame([("a", "x", None, 5), (None, "y", START, 500)], KIND)
    assert {r.id: r.reason for r in admissions(none, "user", "ts", "id", "tokens", LIMITS).collect()} == {"x": "ok", "y": "tpm_limit"}
    assert admissions(spark.createDataFrame([], KIND), "user", "ts", "id", "tokens", LIMITS).collect() == []
    assert Counters(limits=Limits(1)).admit(119, 0) == (True, 0.0, "ok")


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def run(batches, kind, make, name):
        for i, rows in enumerate(batches):  # one file and one batch each, in this order
            part = tmp_path / f"{name}-{i}"
            spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(part))
            for f in part.glob("*.parquet"):
                (tmp_path / name).mkdir(exist_ok=True)
                f.rename(tmp_path / name / f"{i:03d}.parquet")
        rows = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / name))
        q = make(rows).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_equals_table_on_shuffled_rows(spark, stream):
    rows = requests(3, 240)
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    last = [("zz", "end", START + dt.timedelta(days=9), 1)]  # lets the watermark pass all others
    batches = [shuffled[i::4] for i in range(4)] + [last]
    got = stream(batches, KIND, lambda d: admission_stream(d, "user", "ts", "id", "tokens", LIMITS, late="3 days"), "admit").collect()
    assert {r.id: (r.allowed, r.wait_seconds, r.reason) for r in got} == plain(rows, LIMITS) and len(got) == len(rows)


EVENT = "sid string, pid string, user_id string, name string, action string, ts timestamp"


def test_presence_from_the_stream(spark, stream):
    def at(s):
        return START + dt.timedelta(seconds=s)

    batches = [
        [("s1", "p", "1", "Bo", "enter", at(0)), ("s2", "p", "1", "Bo (tab)", "enter", at(1)), ("s3", "p", "2", None, "enter", at(2)), ("", "p", "9", "x", "enter", at(2)), ("s8", "", "9", "x", "enter", at(2))],
        [("s3", "p", "2", None, "beat", at(50)), ("s4", "q", "3", "Al", "enter", at(20)), ("s1", "p", "1", "Bo", "leave", at(30)), ("s5", "p", "4", "Cy", "enter", at(40)), ("s5", "p", "4", "Cy", "leave", at(45)), ("s6", "p", "6", "Di", "enter", at(41))],
        [("s6", "q", "6", "Di", "enter", at(60)), ("s3", "p", "2", None, "beat", at(100)), ("s2", "p", "1", "Bo (tab)", "beat", at(101))],
        [("s3", "p", "2", None, "beat", at(155)), ("s2", "p", "1", "", "beat", at(156))],
    ]
    changes = stream(batches, EVENT, lambda d: presence_stream(d, idle_seconds=70, late="0 seconds"), "presence")
    online = {(r.pid, r.user_id): (r.name, r.n) for r in online_users(changes).collect()}
    # s4 and s6 fell silent; of user 1 the second tab lives on.
    assert online == {("p", "1"): ("Bo (tab)", 1), ("p", "2"): ("協作者", 2)}
    gone = {r.sid for r in changes.where("NOT online").collect()}
    assert gone == {"s1", "s5", "s4", "s6"} or gone == {"s1", "s4", "s6"}  # s5 came and went in one batch
    moved = [(r.pid, r.online) for r in changes.where("sid = 's6'").orderBy("us", "online").collect()]
    assert moved[:3] == [("p", True), ("p", False), ("q", True)]


def test_first_connection_names_a_user(spark):
    rows = [("s1", "p", "1", "Zed", 5, 9, True), ("s2", "p", "1", "Amy", 3, 8, True), ("s3", "p", "2", "Bob", 4, 4, True), ("s3", "p", "2", "Bob", 4, 6, False)]
    got = online_users(spark.createDataFrame(rows, "sid string, pid string, user_id string, name string, since long, us long, online boolean"))
    assert [tuple(r) for r in got.collect()] == [("p", "1", "Amy", 1)]
