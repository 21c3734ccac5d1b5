"""Keyed state in streams: idempotency, moving average with breaker, latest state, and windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabweave.operators.health import ALPHA, EJECTION_NS, START_NS, THRESHOLD


def first_only(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key once. With an event time, a key is remembered for ``late`` only, so state stays bounded."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window and keys; rows later than ``late`` are dropped."""
    at = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(at, *keys).count()


def health(reports: DataFrame, key: str, alpha: float = ALPHA, threshold: int = THRESHOLD, ejection_ns: int = EJECTION_NS, forget: str = "10 minutes") -> DataFrame:
    """(key, ewma, failures, ejected_until) after each micro-batch of reports (key, seq, at_ns, latency, ok); a key unheard of for ``forget`` loses its state."""
    minutes_ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ewma, failures, until = state.get if state.exists else (START_NS, 0, 0)
        for r in pd.concat(parts).sort_values("seq").itertuples():
            ewma = int((1 - alpha) * ewma + alpha * r.latency)
            if r.ok:
                failures, until = 0, 0
                continue
            probe = until > 0 and r.at_ns >= until
            failures = 0 if probe or failures + 1 >= threshold else failures + 1
            if failures == 0:
                until = int(r.at_ns) + ejection_ns
        state.update((ewma, failures, until))
        state.setTimeoutDuration(minutes_ms)
        yield pd.DataFrame({key: [k[0]], "ewma": [ewma], "failures": [failures], "ejected_until": [until]})

    kind = reports.schema[key].dataType.simpleString()
    out, kept = f"{key} {kind}, ewma long, failures long, ejected_until long", "ewma long, failures long, until long"
    return reports.groupBy(key).applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.ProcessingTimeTimeout)


def latest_state(changes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, op, value, revision) of every key a micro-batch changed; a change that is not newer than the key's last is ignored."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else -1
        rows = pd.concat(parts)
        last = rows.loc[rows["revision"].idxmax()]
        if int(last["revision"]) > known:
            state.update((int(last["revision"]),))
            yield pd.DataFrame({key: [k[0]], "op": [last["op"]], value: [last[value]], "revision": [int(last["revision"])]})

    kinds = {c: changes.schema[c].dataType.simpleString() for c in (key, value)}
    return changes.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, op string, {value} {kinds[value]}, revision long", "revision long", "update", GroupStateTimeout.NoTimeout)
