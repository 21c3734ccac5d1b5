"""At most one commit per (namespace, key): the first attempt that succeeds commits, later ones are conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths in characters, and hash partitions of the record table.
MOST_NAMESPACE, MOST_KEY, PARTITIONS = 128, 256, 64


def valid_key(namespace: Column, key: Column) -> Column:
    ok = lambda c, n: (F.length(F.trim(c)) > 0) & (F.length(c) <= n)
    return F.coalesce(ok(namespace, MOST_NAMESPACE) & ok(key, MOST_KEY), F.lit(False))


def outcomes(attempts: DataFrame, namespace: str, key: str, order: str, ok: Column, committed: DataFrame | None = None) -> DataFrame:
    """``attempts`` with ``outcome``: committed, rolled_back (failed before any success; a retry may run) or conflict.

    Only the smallest successful place of a key is needed, so a hot key is reduced by partial aggregation before it is
    joined back. ``committed`` (namespace, key) are keys of earlier runs; all their attempts are conflicts."""
    first = attempts.where(ok).groupBy(namespace, key).agg(F.min(order).alias("__first"))
    out = attempts.join(first, [namespace, key], "left")
    before = F.lit(False)
    if committed is not None:
        out = out.join(committed.select(namespace, key).distinct().withColumn("__done", F.lit(True)), [namespace, key], "left")
        before = F.col("__done").isNotNull()
    outcome = F.when(before | (F.col(order) > F.col("__first")), "conflict").when(F.col(order) == F.col("__first"), "committed").otherwise("rolled_back")
    return out.withColumn("outcome", outcome).select(*attempts.columns, "outcome")


def record_partition(namespace: Column, key: Column, partitions: int = PARTITIONS) -> Column:
    """Partition of a record: a hash that any engine can repeat (the first 32 bits of both parts' MD5)."""
    digest = F.md5(F.concat_ws("\x1f", namespace, key).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(partitions))
