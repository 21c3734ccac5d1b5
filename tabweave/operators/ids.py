"""Ids without coordination per row: time-ordered ids by bits, and ranges that a tag allocates in one step.

``snowflake`` columns pack, unpack and assign 63-bit ids of 41 bits of milliseconds, 10 of worker and 12 of sequence.
Segments give every row of a batch a dense id from one range per tag: the driver sees one row per tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.ordered import ranged, shifts
from tabweave.plans.errors import InvalidArgument

#: Bit widths of the id layout, and its default epoch (2020-01-01 UTC, milliseconds).
TIME_BITS, WORKER_BITS, SEQUENCE_BITS, EPOCH = 41, 10, 12, 1577836800000
MOST_WORKERS, PER_MS = 1 << WORKER_BITS, 1 << SEQUENCE_BITS
DEFAULT_STEP, MAX_ID = 1000, (1 << 63) - 1


def pack(ms: Column, worker: Column, sequence: Column, epoch: int = EPOCH) -> Column:
    """The id; times before the epoch or past 41 bits, and parts out of range, are errors."""
    elapsed = ms - F.lit(epoch)
    ok = elapsed.between(0, (1 << TIME_BITS) - 1) & worker.between(0, MOST_WORKERS - 1) & sequence.between(0, PER_MS - 1)
    value = F.shiftleft(elapsed.cast("long"), WORKER_BITS + SEQUENCE_BITS).bitwiseOR(F.shiftleft(worker.cast("long"), SEQUENCE_BITS)).bitwiseOR(sequence.cast("long"))
    return F.when(ok, value).otherwise(F.raise_error(F.lit("time, worker or sequence does not fit an id")).cast("long"))


def time_of(id_: Column, epoch: int = EPOCH) -> Column:
    return F.shiftright(id_, WORKER_BITS + SEQUENCE_BITS) + F.lit(epoch)


def worker_of(id_: Column) -> Column:
    return F.shiftright(id_, SEQUENCE_BITS).bitwiseAND(F.lit(MOST_WORKERS - 1))


def sequence_of(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit(PER_MS - 1))


def assign(rows: DataFrame, ms: str, worker: str, order: list[str], name: str = "id", epoch: int = EPOCH) -> DataFrame:
    """Number rows of a worker in order of time. A full millisecond spills into the next: row k of the worker gets slot
    max over rows up to k of (time slot - place) + place, which is the sequential rule in closed form.

    Rows are range-partitioned by worker and time; places and maxima before a partition come from one row per partition
    and worker, so a worker with most rows is not one task's. Every window is inside one partition."""
    time_slot = (F.col(ms) - F.lit(epoch)) * PER_MS - F.col("__i")
    placed = ranged(rows, [worker], [ms, *order]).withColumn("__ahead", time_slot)
    per = shifts(placed, [worker], __top=F.max("__ahead"))
    earlier = Window.partitionBy(worker).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.max(F.col("__top") - F.col("__shift")).over(earlier)).drop("__top")
    within = Window.partitionBy("__p", worker).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("__ahead", F.max("__ahead").over(within)).join(per, ["__p", worker])
    slot = F.greatest(F.col("__ahead") - F.col("__shift"), F.col("__before")) + F.col("__i") + F.col("__shift")
    out = out.withColumn("__slot", slot)
    time, sequence = F.floor(F.col("__slot") / PER_MS).cast("long") + F.lit(epoch), F.pmod(F.col("__slot"), F.lit(PER_MS))
    return out.select(*rows.columns, pack(time, F.col(worker), sequence, epoch).alias(name))


def lease_candidate(workers: DataFrame, now: int, stale_ms: int = 15_000) -> DataFrame:
    """(worker_id, reclaimed): the worker to lease next: the longest unheard of over ``stale_ms``, else one above the largest; none past the last."""
    stale = workers.where(F.col("updated_at") < now - stale_ms).orderBy("updated_at", "worker_id").limit(1).select(F.col("worker_id").cast("int").alias("worker_id"), F.lit(True).alias("reclaimed"))
    fresh = workers.agg((F.coalesce(F.max("worker_id"), F.lit(-1)) + 1).cast("int").alias("worker_id")).where(F.col("worker_id") < MOST_WORKERS).withColumn("reclaimed", F.lit(False))
    return stale.unionByName(fresh).orderBy(F.col("reclaimed").desc()).limit(1)


def last_timestamp(workers: DataFrame) -> DataFrame:
    """The clock guard: no id before this time."""
    return workers.agg(F.coalesce(F.max("last_timestamp"), F.lit(0)).cast("long").alias("last_timestamp"))


def init_segment(table: DataFrame, tag: str, start: int = 0, step: int = DEFAULT_STEP) -> DataFrame:
    """``table`` (biz_tag, max_id, step) with the tag: a known tag changes its step and never its max_id; a step under 1 means the default."""
    if start < 0:
        raise InvalidArgument("a segment cannot start below zero")
    if step <= 0:
        step = DEFAULT_STEP
    if start > MAX_ID - step:
        start = min(start, MAX_ID)
    from tabweave.operators.mutate import upsert

    new = table.sparkSession.range(1).select(F.lit(tag).alias("biz_tag"), F.lit(start).cast("long").alias("max_id"), F.lit(step).cast("int").alias("step"))
    return upsert(table, new, ["biz_tag"], ["step"]).table


def allocate(rows: DataFrame, segments: DataFrame, tag: str, order: list[str], name: str = "id") -> tuple[DataFrame, DataFrame]:
    """Give each row of ``rows`` the next id of its tag, in ``order``; the numbered rows and the segments after it.

    Ids of a tag are start + 1, start + 2, ...; max_id moves in whole steps. A tag without a segment starts at 0 with
    the default step; a row without a tag gets no id. Rows are range-partitioned by tag and order, numbered once and
    kept in the checkpoint folder; the numbers before a partition come from counts per (partition, tag), so a tag with
    most of the rows is not one task's. Running out of 63 bits is an error."""
    placed = ranged(rows, [tag], order)
    known = segments.select(F.col("biz_tag").alias(tag), F.col("max_id").alias("__start"))
    start, nth = F.coalesce("__start", F.lit(0)), F.col("__shift") + F.col("__i") + 1
    value = F.when(start <= F.lit(MAX_ID) - nth, start + nth).otherwise(F.raise_error(F.lit("segment ids are used up")).cast("long"))
    numbered = placed.join(shifts(placed, [tag]), ["__p", tag], "left").join(known, tag, "left")
    numbered = numbered.select(*rows.columns, F.when(F.col(tag).isNotNull(), value).alias(name))
    taken = rows.where(F.col(tag).isNotNull()).groupBy(F.col(tag).alias("biz_tag")).agg(F.count("*").alias("__taken"))
    step, max_id = F.coalesce("step", F.lit(DEFAULT_STEP)), F.coalesce("max_id", F.lit(0))
    steps = F.ceil(F.coalesce("__taken", F.lit(0)) / step)
    after = segments.join(taken, "biz_tag", "full_outer").select("biz_tag", (max_id + steps * step).cast("long").alias("max_id"), step.cast("int").alias("step"))
    return numbered, after


def retryable(code: Column) -> Column:
    """Whether a database error code means 'again': deadlock, lock wait or serialisation."""
    return F.coalesce(code.cast("string").isin("1205", "1213", "40001", "40P01"), F.lit(False))


def duplicate_key(code: Column) -> Column:
    """Whether a database error code means a key that is there already."""
    return F.coalesce(code.cast("string").isin("1062", "23505"), F.lit(False))
