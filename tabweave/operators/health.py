"""Health of instances as ordered folds: moving average, circuit breaker, token bucket, and the pick of two.

Folds depend on order and are exact. The average and the breaker forget what came long before, so a key with most of
the rows is folded in its range partitions side by side (``ordered.fold_ordered``). A token bucket keeps counts from its
first request on: its keys are folded one after another in sorted partitions with one state in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.cluster import ship
from tabweave.operators.ordered import fold_ordered, ranged, shifts

#: Weight of a new sample, first average (10 ms), failures that eject, and for how long (30 s), in nanoseconds.
ALPHA, START_NS, THRESHOLD, EJECTION_NS = 0.2, 10_000_000, 3, 30_000_000_000


class Average:
    """State: the average. It grows with the one before, so the least and the largest bound every other."""

    def __init__(self, alpha: float, start: int):
        self.alpha, self.first = alpha, start

    def start(self) -> int:
        return self.first

    def unknown(self) -> list[int]:
        return [-(1 << 62), 1 << 62]

    def step(self, state: int, row: tuple) -> int:
        return int((1 - self.alpha) * state + self.alpha * row[0])


class AverageOfEndpoint(Average):
    """State: (endpoint, average); a new endpoint begins at the start."""

    def start(self) -> tuple:
        return None, self.first

    def unknown(self) -> list[tuple]:
        return [(NotImplemented, s) for s in super().unknown()]

    def step(self, state: tuple, row: tuple) -> tuple:
        same = state[0] is NotImplemented or state[0] == row[0]
        return row[0], super().step(state[1] if same else self.first, row[1:])


class Breaker:
    """State: (failures, ejected until), None while unknown; a success clears it whatever it was."""

    def __init__(self, threshold: int, ejection_ns: int):
        self.threshold, self.ejection = threshold, ejection_ns

    def start(self) -> tuple:
        return 0, 0

    def unknown(self) -> list:
        return [None, (0, 0)]

    def step(self, state: tuple | None, row: tuple) -> tuple | None:
        at, ok = row
        if ok:
            return 0, 0
        if state is None:
            return None
        failures, until = state
        if (until > 0 and at >= until) or failures + 1 >= self.threshold:
            return 0, at + self.ejection
        return failures + 1, until


def ewma(samples: DataFrame, key: list[str], order: str, latency: str, alpha: float = ALPHA, start: int = START_NS) -> DataFrame:
    """(key, ewma): each step gives trunc((1 - alpha) * old + alpha * sample)."""
    return fold_ordered(samples, key, order, [latency], Average(alpha, start), [("ewma", "long", pa.int64())], lambda s: (s,))


def breaker(reports: DataFrame, key: list[str], order: str, at_ns: str, ok: Column, threshold: int = THRESHOLD, ejection_ns: int = EJECTION_NS) -> DataFrame:
    """(key, failures, ejected_until): a success clears; a failure counts, and at the threshold, or as the probe after an
    ejection has run out, ejects again and clears the count."""
    rows = reports.select(*key, order, F.col(at_ns).alias("__at"), ok.alias("__ok"))
    return fold_ordered(rows, key, order, ["__at", "__ok"], Breaker(threshold, ejection_ns), [("failures", "long", pa.int64()), ("ejected_until", "long", pa.int64())], lambda s: s)


def carry_over(samples: DataFrame, key: list[str], order: str, endpoint: str, latency: str, alpha: float = ALPHA, start: int = START_NS) -> DataFrame:
    """(key, endpoint, ewma): the average goes on while the endpoint stays and starts anew when it changes."""
    rows = samples.withColumn(endpoint, F.col(endpoint).cast("string"))
    return fold_ordered(rows, key, order, [endpoint, latency], AverageOfEndpoint(alpha, start), [("endpoint", "string", pa.string()), ("ewma", "long", pa.int64())], lambda s: s)


def eligible(ejected_until: Column, half_open: Column, now_ns: Column) -> Column:
    """Not ejected, or the ejection is over and nobody probes."""
    return (ejected_until == 0) | ((now_ns >= ejected_until) & ~half_open)


def score(average: Column, inflight: Column) -> Column:
    return average.cast("double") * (inflight + 1)


def _draw(request: Column, nth: Column, n: Column) -> Column:
    """A number from 1 to ``n`` by the request and the draw; any engine with MD5 can repeat it."""
    digest = F.md5(F.concat_ws(":", request.cast("string"), nth.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n) + 1


def pick_of_two(requests: DataFrame, instances: DataFrame, request: str, service: str, now_ns: Column, draws: int = 8) -> DataFrame:
    """(request, service, id, all_ejected): two different eligible instances by the request's hash, the lower score wins, a tie keeps the first.

    ``instances`` has id, ewma, inflight, ejected_until and half_open per service; ``request`` names a request once. If
    ``draws`` draws do not find two, the first eligible ones by id fill up; if none is eligible, the ejection that ends
    first and is not being probed is taken. Instances are numbered per service and drawn numbers are joined with
    them by (service, number), so a request carries its draws and never the service's instances."""
    placed = ranged(instances.withColumns({"__score": score(F.col("ewma"), F.col("inflight")), "__ok": eligible(F.col("ejected_until"), F.col("half_open"), now_ns)}), [service], ["id"])
    numbered = placed.join(shifts(placed, [service]), ["__p", service]).select(service, (F.col("__i") + F.col("__shift") + 1).alias("__number"), "id", "__score", "__ok")
    one = F.struct("id", F.col("__score").alias("score"))
    per = placed.groupBy(service).agg(F.count("*").alias("__n"), F.min(F.when(F.col("__ok"), one)).alias("__one"), F.min(F.when(~F.col("half_open"), F.struct("ejected_until", "id"))).alias("__soonest"))
    two = placed.where("__ok").join(per.select(service, F.col("__one.id").alias("__least")), service).where(F.col("id") > F.col("__least")).groupBy(service).agg(F.min(one).alias("__two"))
    per = per.join(two, service, "left")
    asked = requests.select(F.col(request).alias("__request"), service).join(per.select(service, "__n"), service)
    drawn = asked.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__number", _draw(F.col("__request"), F.col("__nth"), F.col("__n")))
    found = drawn.join(numbered.where("__ok"), [service, "__number"]).groupBy("__request", service).agg(F.array_sort(F.collect_list(F.struct("__nth", "id", F.col("__score").alias("score")))).alias("__found"))
    # at most ``draws`` in a list: the first, and the first other one
    first = F.get("__found", F.lit(0))
    other = F.get(F.filter("__found", lambda x: x["id"] != first["id"]), F.lit(0))
    found = found.select("__request", service, F.struct(first["id"].alias("id"), first["score"].alias("score")).alias("__a"), F.when(other.isNotNull(), F.struct(other["id"].alias("id"), other["score"].alias("score"))).alias("__b"))
    out = asked.join(found, ["__request", service], "left").join(per.drop("__n"), service)
    a = F.coalesce("__a", "__one")
    b = F.coalesce(F.col("__b"), F.when(F.col("__one.id") != a["id"], F.col("__one")), F.col("__two"))
    chosen = F.when(a.isNull(), F.col("__soonest.id")).when(b["score"] < a["score"], b["id"]).otherwise(a["id"])
    return out.select(F.col("__request").alias(request), service, chosen.alias("id"), a.isNull().alias("all_ejected"))


def token_bucket(requests: DataFrame, key: list[str], order: str, at_s: str, rate: float, burst: int) -> DataFrame:
    """(key, allowed, rejected, tokens): a bucket of ``burst`` tokens per key that fills at ``rate`` a second; an empty one rejects."""
    if rate <= 0 or burst <= 0:
        raise ValueError("rate and burst must be positive")
    ship(requests.sparkSession)
    rows = requests.select(*key, order, F.col(at_s).cast("double").alias("__at"))
    kinds, n_key = {n: rows.schema[n].dataType.simpleString() for n in key}, len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        tokens, last, allowed, rejected = float(burst), None, 0, 0

        def flush():
            columns = list(zip(*out, strict=True))
            types = [*schema.types[:n_key], pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*key, "allowed", "rejected", "tokens"])

        for batch in batches:
            schema = batch.schema
            for *k, at in zip(*(batch.column(c).to_pylist() for c in (*range(n_key), n_key + 1)), strict=True):
                if k != now:
                    if now is not None:
                        out.append((*now, allowed, rejected, tokens))
                    now, tokens, last, allowed, rejected = k, float(burst), None, 0, 0
                last = at if last is None else last
                tokens = min(float(burst), tokens + max(at - last, 0.0) * rate)
                last = max(at, last)
                if tokens >= 1:
                    tokens, allowed = tokens - 1, allowed + 1
                else:
                    rejected += 1
            if out:
                yield flush()
                out = []
        if now is not None:
            out.append((*now, allowed, rejected, tokens))
            yield flush()

    ordered = rows.repartition(*key).sortWithinPartitions(*key, order)
    return ordered.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in key) + ", allowed long, rejected long, tokens double")
