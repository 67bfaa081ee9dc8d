"""Job status events, queue receives and alarms as streams with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from code_impact.operators.events import MAX_RECEIVES, TRANSITIONS, alarm_tests, service_metrics

_OUTPUT = "event_id long, job_id long, previous string, status string, valid boolean, allowed string"
_HELD = "status string, times array<long>, ids array<long>, statuses array<string>"
# A job without events for this long is forgotten; jobs expire after as many days.
IDLE_MS = 90 * 86400 * 1000
# A queue keeps a message for this long, so its receives need not be known any longer.
RETENTION_MS = 14 * 86400 * 1000


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({c: [] for c in columns}, dtype=object), *(b[columns].astype(object) for b in batches)])


def _steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold a job's events until the watermark has passed them, then give them in order of time."""
    before, times, ids, statuses = state.get if state.exists else (None, [], [], [])
    held = list(zip(times, ids, statuses))
    if not state.hasTimedOut:
        new = _rows(batches, ["ts", "event_id", "status"])
        at = [(t - pd.Timestamp(0)) // pd.Timedelta(microseconds=1) for t in new["ts"]]
        held += zip(at, map(int, new["event_id"]), new["status"])
    passed = state.getCurrentWatermarkMs()
    held.sort()
    due = [e for e in held if e[0] <= passed * 1000]
    held = held[len(due) :]
    if state.hasTimedOut and not due and not held:
        state.remove()
        return
    previous = [before, *(e[2] for e in due)][: len(due)]
    last = due[-1][2] if due else before
    state.update((last, [e[0] for e in held], [e[1] for e in held], [e[2] for e in held]))
    # Woken when the watermark passes the oldest held event, or, with none, when the job has been idle for long.
    state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, passed + 1) if held else passed + IDLE_MS)
    if due:
        allowed = [TRANSITIONS.get(p, []) if p is not None else [] for p in previous]
        yield pd.DataFrame(
            {
                "event_id": [e[1] for e in due],
                "job_id": key[0],
                "previous": previous,
                "status": [e[2] for e in due],
                "valid": [p is None or e[2] in a for p, e, a in zip(previous, due, allowed)],
                "allowed": [",".join(a) for a in allowed],
            }
        )


def job_transitions(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Status events with the step each makes, in order of event time whatever the order of arrival; run in append mode.

    An event is judged once the watermark has passed it; events that come later than ``lateness`` are dropped. The state of a job
    is one status and the events of the last ``lateness``.
    """
    timed = events.withWatermark("ts", lateness)
    return timed.groupBy("job_id").applyInPandasWithState(_steps, _OUTPUT, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def _received(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    passed = state.getCurrentWatermarkMs()
    seen, newest = state.get if state.exists else (0, 0)
    if newest + RETENTION_MS <= passed:
        seen = 0
    at = [int(t.timestamp() * 1000) for t in _rows(batches, ["received_at"])["received_at"]]
    seen, newest = seen + len(at), max(newest, *at)
    state.update((seen, newest))
    state.setTimeoutTimestamp(max(newest, passed) + RETENTION_MS)
    most = MAX_RECEIVES.get(key[0])
    if most is not None and seen >= most:
        yield pd.DataFrame({"queue": [key[0]], "message_id": [key[1]], "receives": [seen]})


def dead_letter_stream(receives: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Messages that reached the limit of their queue; run in update mode.

    A count is forgotten once its queue no longer keeps the message (``RETENTION_MS`` after the last receive); a receive
    (``received_at``) that comes later than ``lateness`` is dropped.
    """
    timed = receives.withWatermark("received_at", lateness).withColumn("message_id", F.col("message_id").cast("long"))
    grouped = timed.groupBy("queue", "message_id")
    schema = "queue string, message_id long, receives long"
    return grouped.applyInPandasWithState(_received, schema, "n long, newest long", "update", GroupStateTimeout.EventTimeTimeout)


def period_mean_stream(events: DataFrame, metrics: list[str], period_s: int = 300, lateness: str = "10 minutes") -> DataFrame:
    """Mean per metric and closed period (``period``: seconds); run in append mode into a folder that ``alarm_stream`` reads."""
    wanted = events.where(F.col("metric").isin(metrics)).select("ts", "metric", "value").withWatermark("ts", lateness)
    means = wanted.groupBy(F.window("ts", f"{period_s} seconds").alias("w"), "metric").agg(F.avg("value").alias("mean"))
    return means.select("metric", F.unix_seconds("w.start").alias("period"), "mean")


def alarm_stream(means: DataFrame, alarms: dict[str, tuple[str, float, int, str]], period_s: int = 300) -> DataFrame:
    """``metric_alarms`` over the folder of ``period_mean_stream``; run in append mode.

    Two streams, as state by metric cannot follow an aggregation in one, and so that a busy metric sends one row a period here.
    The state of a metric is its last period and how many in a row broke the threshold. Periods without data are given
    once a later period of the metric closes. The folder must be read without a limit of files, as periods come in order of batches.
    """
    tests = alarm_tests(alarms)

    def judged(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = _rows(batches, ["period", "mean"]).sort_values("period")
        last, run = state.get if state.exists else (None, 0)
        breaks, needed = tests[key[0]]
        out = []
        for period, mean in zip(map(int, new["period"]), new["mean"]):
            for at in range(period if last is None else last + period_s, period + 1, period_s):
                value = mean if at == period else None
                breaking = breaks(value)
                run = run + 1 if breaking else 0
                out.append((key[0], pd.Timestamp(at, unit="s"), value, breaking, run >= needed))
                if len(out) == 10_000:
                    yield pd.DataFrame(out, columns=["metric", "period_start", "mean", "breaching", "alarm"])
                    out = []
            last = period
        state.update((last, run))
        if out:
            yield pd.DataFrame(out, columns=["metric", "period_start", "mean", "breaching", "alarm"])

    schema = "metric string, period_start timestamp, mean double, breaching boolean, alarm boolean"
    return means.groupBy("metric").applyInPandasWithState(judged, schema, "last long, run long", "append", GroupStateTimeout.NoTimeout)


def service_metric_stream(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Closed metric windows; run in append mode."""
    return service_metrics(events.select(F.col("ts"), "service", "metric", "value").withWatermark("ts", lateness), width)
