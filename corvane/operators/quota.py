"""Admission of requests under three limits: requests and tokens a minute, requests a day.

What is refused uses nothing, so a key's requests are decided one after another, in order of time.
One rule decides for tables and streams; a table's rows pass it sorted, and nothing is gathered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.accounts import micros

# Widths of the windows and the least waits, in seconds.
MINUTE, DAY, LEAST_WAIT, LEAST_DAY_WAIT = 60, 86_400, 1.0, 60.0
DECISION = "allowed boolean, wait_seconds double, reason string"


@dataclass(frozen=True)
class Limits:
    """Zero or less: no such limit. least_cost: what a request counts at least, in tokens."""

    requests_a_minute: int = 0
    tokens_a_minute: int = 0
    requests_a_day: int = 0
    least_cost: int = 0


@dataclass
class Counters:
    """What a key has used in the minute and the day of its last request."""

    minute: int = -1
    requests: int = 0
    tokens: int = 0
    day: int = -1
    day_requests: int = 0
    limits: Limits = field(default_factory=Limits)

    def admit(self, second: int, cost: int) -> tuple[bool, float, str]:
        """Whether a request goes through, else how long to wait and which limit says so."""
        at = self.limits
        if max(at.requests_a_minute, at.tokens_a_minute, at.requests_a_day) <= 0:
            return True, 0.0, "ok"
        cost = max(cost, at.least_cost)
        minute, day = second // MINUTE, second // DAY
        if minute != self.minute:
            self.minute, self.requests, self.tokens = minute, 0, 0
        if day != self.day:
            self.day, self.day_requests = day, 0
        wait = max(LEAST_WAIT, float(MINUTE - second % MINUTE))
        if 0 < at.requests_a_minute < self.requests + 1:
            return False, wait, "rpm_limit"
        if 0 < at.tokens_a_minute < self.tokens + cost:
            return False, wait, "tpm_limit"
        if 0 < at.requests_a_day < self.day_requests + 1:
            return False, max(LEAST_DAY_WAIT, float(DAY - second % DAY)), "rpd_limit"
        self.requests, self.tokens, self.day_requests = self.requests + 1, self.tokens + cost, self.day_requests + 1
        return True, 0.0, "ok"


def admissions(requests: DataFrame, key: str, ts: str, tie: str, tokens: str, limits: Limits) -> DataFrame:
    """requests with allowed, wait_seconds and reason (J03, J04): ok, rpm_limit, tpm_limit, rpd_limit.

    A key's requests of a day are taken in order of ts, then tie; they lie sorted in one task, which
    holds a few counters. Null tokens count as 0; rows without ts are allowed and use nothing.
    Empty table: empty result. Columns of the three names are replaced."""
    rows = requests.drop("allowed", "wait_seconds", "reason")
    rows = rows.withColumn("__us", micros(F.col(ts))).withColumn("__day", F.floor(F.col("__us") / (DAY * 1_000_000)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + DECISION

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, Counters(limits=limits)
        for b in batches:
            out = []
            for k, d, us, cost in zip(b[key], b["__day"], b["__us"], b[tokens]):
                if pd.isna(us):
                    out.append((True, 0.0, "ok"))
                    continue
                if (k, d) != now:
                    now, used = (k, d), Counters(limits=limits)
                out.append(used.admit(int(us) // 1_000_000, 0 if pd.isna(cost) else int(cost)))
            yield b.assign(**dict(zip(("allowed", "wait_seconds", "reason"), map(list, zip(*out)))) if out else {"allowed": [], "wait_seconds": [], "reason": []})

    dealt = rows.repartition(key, "__day").sortWithinPartitions(key, "__day", "__us", tie)
    return dealt.mapInPandas(run, kind).drop("__us", "__day")
