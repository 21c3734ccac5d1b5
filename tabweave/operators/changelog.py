"""Changelog to latest state: puts and deletes with revisions, a snapshot to start from, stale revisions ignored.

Only the last change of a key decides, so a hot key is reduced where it is read (max_by has partial sums); no key's
history is ever in one place. Instances are the rows of a service registry: (service, id, endpoint, metadata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the version that a stored instance carries.
VERSION = 1
INSTANCE = "version INT, service STRING, id STRING, endpoint STRING, metadata MAP<STRING,STRING>"


def latest(changes: DataFrame, key: list[str], revision: str, op: str, deleted: str = "DELETE") -> DataFrame:
    """The last change of every key, without keys whose last change deletes."""
    rest = [c for c in changes.columns if c not in key]
    out = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(revision)).alias("s"))
    return out.select(*key, *(F.col(f"s.{c}").alias(c) for c in rest)).where(F.col(op) != deleted)


def apply_changes(snapshot: DataFrame, snapshot_revision: int, changes: DataFrame, key: list[str], revision: str, op: str) -> DataFrame:
    """State after a snapshot and the changes that are newer; changes up to its revision are stale. ``snapshot`` has the columns of ``changes`` but ``op``."""
    base = snapshot.withColumn(op, F.lit("PUT")).select(*changes.columns).withColumn(revision, F.lit(snapshot_revision).cast(changes.schema[revision].dataType))
    return latest(base.unionByName(changes.where(F.col(revision) > snapshot_revision)), key, revision, op)


def newest_snapshot(snapshots: DataFrame, revision: str) -> DataFrame:
    """Rows of the snapshot with the highest revision; an older one that arrives late does not replace it."""
    top = snapshots.agg(F.max(revision).alias("__top"))
    return snapshots.join(F.broadcast(top), F.col(revision) == F.col("__top")).drop("__top")


def encode(service: Column, id_: Column, endpoint: Column, metadata: Column) -> Column:
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), service.alias("service"), id_.alias("id"), endpoint.alias("endpoint"), metadata.alias("metadata")))


def decode(value: Column) -> Column:
    """The stored instance as a struct; NULL if it cannot be read, has another version or is not valid."""
    parsed = F.from_json(value, INSTANCE)
    return F.when((parsed["version"] == VERSION) & valid(parsed["service"], parsed["id"], parsed["endpoint"], parsed["metadata"]), parsed)


def _segment(name: Column) -> Column:
    t = F.trim(name)
    return name.isNotNull() & (t != "") & ~t.isin(".", "..") & ~t.rlike(r"[/\\]")


def valid(service: Column, id_: Column, endpoint: Column, metadata: Column) -> Column:
    """Names are one path segment, the endpoint is http://host:port and nothing more, no metadata key is blank."""
    address = endpoint.rlike(r"^http://(\[[0-9A-Fa-f:.]+\]|[^:/?#@\[\]\s]+):[0-9]+$")
    keys = F.coalesce(F.forall(F.map_keys(metadata), lambda k: F.trim(k) != ""), F.lit(True))
    return F.coalesce(_segment(service) & _segment(id_) & address & keys, F.lit(False))


def watched(changes: DataFrame, value: str, key: list[str], revision: str, op: str) -> tuple[DataFrame, DataFrame]:
    """(state, bad): decoded latest state; a value that cannot be decoded is counted and skipped, and its key keeps its last good value."""
    decoded = changes.withColumn("instance", decode(F.col(value)))
    bad = (F.col(op) == "PUT") & F.col("instance").isNull()
    return latest(decoded.where(~bad).drop(value), key, revision, op), decoded.agg(F.sum(bad.cast("long")).alias("bad"), F.max(revision).alias("revision"))


def lease_alive(heartbeat_ms: Column, ttl_ms: int, now_ms: Column) -> Column:
    """A lease lasts its time to live in whole seconds, rounded up, from the last heartbeat."""
    return heartbeat_ms + F.lit(-(-ttl_ms // 1000) * 1000) >= now_ms


def idle(active: Column, last_used_ms: Column, now_ms: Column, after_ms: int = 600_000) -> Column:
    return (active == 0) & (now_ms - last_used_ms >= after_ms)


def first_reports(reports: DataFrame, resolution: str, order: str) -> DataFrame:
    """One report per resolution, the first; a latency that is not positive is no report."""
    good = reports.where(F.col("latency") > 0)
    rest = [c for c in good.columns if c != resolution]
    out = good.groupBy(resolution).agg(F.min_by(F.struct(*rest), F.col(order)).alias("s"))
    return out.select(resolution, *(F.col(f"s.{c}").alias(c) for c in rest))


def statistics(changes: DataFrame, state: DataFrame, op: str, service: str = "service") -> DataFrame:
    """Gauges and counters of a registry in one row: puts, deletes, last revision; instances and services of the state."""
    counts = changes.agg(F.count_if(F.col(op) == "PUT").alias("puts"), F.count_if(F.col(op) == "DELETE").alias("deletes"), F.coalesce(F.max("revision"), F.lit(0)).alias("revision"))
    gauges = state.agg(F.count("*").alias("instances"), F.count_distinct(service).alias("services"))
    return counts.join(F.broadcast(gauges))  # one row and one row
