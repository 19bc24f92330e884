"""Login lockout: three failures in a row lock the user for 15 minutes; attempts while
locked are ignored; a success or the lock's expiry resets the count.

The state machine per user is sequential. In batch it runs over stretches of
a user's attempts sorted by ``(ts, event_id)`` that no earlier attempt can influence; in
a stream it runs with ``transformWithStateInPandas``: attempts wait for the watermark, event-time
timers replay them in order and end locks.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as K

OUT_SCHEMA = ("user_id bigint, event_id bigint, ts timestamp_ntz, success boolean, outcome string, "
              "failures int, locked_until timestamp_ntz")
STATE_SCHEMA = "failures int, locked_until timestamp_ntz"


def login_attempts(events: DataFrame) -> DataFrame:
    """Login attempts from events: ``error`` is a failed login, ``signup`` a successful one."""
    return (events.filter(F.col("event_type").isin("error", "signup"))
            .select("user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("success")))


def step(failures: int, locked_until, ts, success: bool,
         lock_after: int = K.LOCK_AFTER_FAILURES, minutes: int = K.LOCK_MINUTES):
    """One attempt: returns (outcome, failures, locked_until)."""
    if locked_until is not None and ts < locked_until:
        return "ignored_locked", failures, locked_until
    if locked_until is not None:
        failures, locked_until = 0, None
    if success:
        return "success", 0, None
    failures += 1
    if failures >= lock_after:
        return "locked", failures, ts + timedelta(minutes=minutes)
    return "failed", failures, None


def lockout_batch(attempts: DataFrame) -> DataFrame:
    """Batch T3 over whole history, one job.

    A success at least ``LOCK_MINUTES`` after the user's previous attempt leaves no failure and no lock, whatever
    came before, so it starts an independent stretch. Stretches are found by a streaming window over each
    user's attempts; then each is replayed in order by a task that holds one attempt and the state (two
    values) at a time, carried across Arrow batches. A user with very many attempts is many stretches.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) >= F.expr(f"INTERVAL {K.LOCK_MINUTES} MINUTES")
    fresh = (F.col("success") & F.coalesce(gap, F.lit(True))).cast("bigint")
    cut = (attempts.select("user_id", "event_id", "ts", "success").withColumn("_fresh", fresh)
           .withColumn("_stretch", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh"))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, failures, locked = None, 0, None
        for pdf in batches:
            out = []
            for uid, eid, ts, ok, stretch in zip(pdf["user_id"], pdf["event_id"], pdf["ts"], pdf["success"], pdf["_stretch"]):
                if (uid, stretch) != now:
                    now, failures, locked = (uid, stretch), 0, None
                ts = pd.Timestamp(ts).to_pydatetime()
                outcome, failures, locked = step(failures, locked, ts, bool(ok))
                out.append((uid, eid, ts, bool(ok), outcome, failures, locked))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "success", "outcome", "failures", "locked_until"])

    return (cut.repartition("user_id", "_stretch").sortWithinPartitions("user_id", "_stretch", "ts", "event_id")
            .mapInPandas(replay, OUT_SCHEMA))


class _Lockout(StatefulProcessor):
    """One user's state machine in event time.

    State: the attempts above the watermark (list) and, while there are failures or a lock, ``failures`` and the lock's
    end. A timer at the earliest open attempt replays what the watermark has passed, in ``(ts, event_id)`` order; a
    timer at the lock's end drops the state, which then equals that of a user never seen.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "us bigint, event_id bigint, success boolean")
        self.state = handle.getValueState("state", "failures int, locked_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = [(int(us), int(eid), bool(ok)) for us, eid, ok in zip(pdf["us"], pdf["event_id"], pdf["success"])
                   if not pd.isna(eid)]
            if new:
                self.open.appendList(new)
                first = min(us for us, _, _ in new) if first is None else min(first, min(us for us, _, _ in new))
        if first is not None:
            self.handle.registerTimer(_due(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r[0], r[1], r[2]) for r in self.open.get()) if self.open.exists() else []
        ready = [r for r in waiting if r[0] <= passed]
        failures, locked_us = self.state.get() if self.state.exists() else (0, None)
        locked = None if locked_us is None else _EPOCH + timedelta(microseconds=int(locked_us))
        out = []
        for us, eid, ok in ready:
            outcome, failures, locked = step(int(failures), locked, _EPOCH + timedelta(microseconds=int(us)), ok)
            out.append((key[0], eid, int(us), ok, outcome, failures, _micros(locked)))
        rest = waiting[len(ready):]
        if ready:
            if rest:
                self.open.put(rest)
                self.handle.registerTimer(_due(rest[0][0]))
            else:
                self.open.clear()
        locked_us = _micros(locked)
        if failures == 0 or locked_us is not None and locked_us <= passed:
            if self.state.exists():
                self.state.clear()
        elif ready:
            self.state.update((int(failures), locked_us))
            if locked_us is not None:
                self.handle.registerTimer(_due(locked_us))
        if out:
            pdf = pd.DataFrame(out, columns=["user_id", "event_id", "us", "success", "outcome", "failures", "locked_us"])
            yield pdf.astype({"user_id": "Int64", "locked_us": "Int64"})

    def close(self) -> None:
        pass


_EPOCH = datetime(1970, 1, 1)


def _micros(ts: datetime | None) -> int | None:
    return None if ts is None else (ts - _EPOCH) // timedelta(microseconds=1)


def _due(us: int) -> int:
    """Timer of an instant: the first full millisecond that isn't before it."""
    return -(-int(us) // 1000)


def lockout_stream(attempts: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Streaming T3 in event time: attempts may come ``delay`` late, in any order and over any micro-batches.

    An attempt is held until the watermark (largest ``ts`` seen less ``delay``) passes it, then replayed in
    ``(ts, event_id)`` order, so the result equals the batch one; attempts later than that are dropped as late. Rows
    without ``event_id`` (heartbeats) yield nothing and only move the watermark on. A user's state is the attempts of the last
    ``delay`` and two values. Needs the RocksDB state store (``streams.rocksdb_state``).
    """
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    timed = (attempts.select("user_id", "event_id", "success", micros.alias("us"))
             .withColumn("_at", F.timestamp_micros("us")).withWatermark("_at", delay))
    out = timed.groupBy("user_id").transformWithStateInPandas(
        _Lockout(), "user_id bigint, event_id bigint, us bigint, success boolean, outcome string, failures int, locked_us bigint",
        "append", "EventTime")

    def wall(c: str):
        return F.expr(f"timestampadd(MICROSECOND, {c}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")

    return out.select("user_id", "event_id", wall("us").alias("ts"), "success", "outcome", "failures",
                      wall("locked_us").alias("locked_until"))
