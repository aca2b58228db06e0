"""The work queue as keyed state of a stream: claims with leases, retries that wait, a cap of attempts.

Each key's job is one row of state, changed by what comes in (enqueue, claim,
finish) and by time alone: a lease that ends makes the job due again, or
exhausts it; a retry's waiting time makes it due. Events are kept until the
watermark has passed them and then applied in order of time, so the order of
arrival, the cut into micro-batches and restarts make no difference: the
transitions are those of a fold over each key's events (tested).

A lookup cache has the same life (a lease while one asks, a cooling-off after a
failure, a result that stays), with other numbers; ``Rules`` holds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events: at, seq (orders those of one time), kind (enqueue, claim, finish), version (of an enqueued input), token (of a claim or finish), failed (a finish's error code).
EVENT = "key string, at timestamp, seq long, kind string, version string, token string, failed string"
TRANSITION = "key string, at timestamp, seq long, state string, attempts int, reason string"
#: As EVENT and TRANSITION within the state, with microseconds instead of time stamps, which no session's time zone touches.
FIELDS = ("at", "seq", "kind", "version", "token", "failed")
WAITING, CHANGED = "at long, seq long, kind string, version string, token string, failed string", "key string, at long, seq long, state string, attempts int, reason string"
JOB = "state string, attempts int, version string, token string, until long, reason string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    lease_seconds: int = 240
    most_attempts: int = 3
    retry_seconds: int = 30
    most_wait: int = 3600

    def wait(self, attempts: int) -> int:
        return min(self.most_wait, self.retry_seconds * 2 ** min(attempts - 1, 10))


@dataclass
class Job:
    state: str = "none"
    attempts: int = 0
    version: str | None = None
    token: str | None = None
    #: When the lease ends (running) or the waiting time (retry_wait), in microseconds.
    until: int | None = None
    reason: str | None = None


def passing(job: Job, now: int, rules: Rules) -> tuple[int, str | None] | None:
    """What time alone does to a job up to now: (when, reason), with the job changed; None if nothing."""
    if job.until is None or job.until > now:
        return None
    at, job.until, job.token = job.until, None, None
    if job.state == "running":
        job.reason = "processing_lease_expired"
        job.state = "exhausted" if job.attempts >= rules.most_attempts else "due"
    else:
        job.state = "due"
    return at, job.reason


def applied(job: Job, at: int, kind: str, version: str | None, token: str | None, failed: str | None, rules: Rules) -> tuple[str, str | None]:
    """(state to report, reason) of an event, with the job changed; ignored and superseded change nothing."""
    if kind == "enqueue":
        if job.state != "none" and job.version == version and job.state != "succeeded":
            return "ignored", None
        job.state, job.attempts, job.version, job.token, job.until, job.reason = "pending", 0, version, None, None, None
    elif kind == "claim":
        if job.state not in ("pending", "due"):
            return "ignored", None
        if job.attempts >= rules.most_attempts:
            job.state, job.reason = "exhausted", job.reason or "processing_attempts_exhausted"
        else:
            job.state, job.attempts, job.token, job.until = "running", job.attempts + 1, token, at + rules.lease_seconds * 1_000_000
    elif job.state != "running" or job.token != token:
        return "superseded", None
    else:
        job.token, job.until, job.reason = None, None, failed
        if failed is None:
            job.state = "succeeded"
        elif job.attempts >= rules.most_attempts:
            job.state = "exhausted"
        else:
            job.state, job.until = "retry_wait", at + rules.wait(job.attempts) * 1_000_000
    return job.state, job.reason


class Leases(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Keeps the events; a timer for the first of them applies in order what the watermark is past, and sets the next."""
        events = []
        for frame in rows:
            columns = (frame[c].tolist() for c in ("at_us", *FIELDS[1:]))
            events += [(at, seq, *[x if isinstance(x, str) else None for x in rest]) for at, seq, *rest in zip(*columns, strict=True)]
        if events:
            self.waiting.appendList(events)
            self._wake(min(e[0] for e in events))
        return iter(())

    def _wake(self, at: int) -> None:
        # A timer is in milliseconds; the next one holds all of this one.
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark is past has come; what it makes due before that too is done now, as no later batch need follow.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        job = Job(*self.job.get()) if self.job.exists() else Job()
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
        ready, later = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        out = []

        def pass_to(moment: int) -> None:
            if (passed := passing(job, moment, self.rules)) is not None:
                out.append((key[0], passed[0], -1, job.state, job.attempts, passed[1]))

        for at, seq, kind, version, token, failed in ready:
            pass_to(at)
            state, reason = applied(job, at, kind, version, token, failed, self.rules)
            out.append((key[0], at, seq, state, job.attempts, reason))
        pass_to(now)
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self._wake(later[0][0])
        if out:
            self.job.update((job.state, job.attempts, job.version, job.token, job.until, job.reason))
            if job.until is not None:
                self._wake(job.until)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGED.split(", ")])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, rules: Rules = Rules(), delay: str = "10 minutes") -> DataFrame:
    """TRANSITION of a stream of EVENT rows; what comes more than ``delay`` behind the latest is too late and dropped.

    seq is that of the event, -1 where time alone made the change.
    """
    watched = events.withColumn("at_us", F.unix_micros("at")).withWatermark("at", delay).groupBy("key")
    changed = watched.transformWithStateInPandas(Leases(rules), CHANGED, outputMode="append", timeMode="EventTime")
    return changed.withColumn("at", F.timestamp_micros("at"))


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the store that has column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def closing(events: DataFrame, days: int = 2) -> DataFrame:
    """events and one row, of no key in use, days after the last: it takes the watermark past them all when a finite input ends."""
    last = events.agg((F.max("at") + F.expr(f"interval {days} days")).alias("at"))
    none = {c: F.lit(None).cast("string") for c in ("version", "token", "failed")}
    return events.unionByName(last.select(F.lit("").alias("key"), "at", F.lit(0).cast("long").alias("seq"), F.lit("close").alias("kind")).withColumns(none))
