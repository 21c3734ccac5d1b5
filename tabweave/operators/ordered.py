"""Order inside groups at any size: rows in range partitions, numbered once, and folds that a hot key does not serialise.

``ranged`` writes its rows to the checkpoint folder, so that every later step sees the same partitions and numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.cluster import shared_dir, ship

_ROW = (1 << 33) - 1


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, whatever becomes of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ranged(rows: DataFrame, group: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` in order of group and order, with __p (range partition, ascending) and __i (place in it, from 0)."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    placed = checkpointed(placed.withColumn("__m", F.monotonically_increasing_id()))
    return placed.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND(F.lit(_ROW))}).drop("__m")


def shifts(placed: DataFrame, group: list[str], **more) -> DataFrame:
    """One row per partition and group of ``ranged`` rows: __shift, which makes __i the place in the group (from 0), and the aggregates ``more``.

    A group has at most as many of these rows as there are partitions."""
    per = placed.groupBy("__p", *group).agg(F.count("*").alias("__rows"), F.min("__i").alias("__first"), *(c.alias(n) for n, c in more.items()))
    earlier = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("__shift", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).drop("__rows", "__first")


class Fold(Protocol):
    """A fold over a key's rows in order. ``states`` holds it from the true start or, at a cut, from all that could
    have come before: ``unknown`` gives states between which every real one lies, and ``step`` keeps that so. When
    they have become equal, what came before no longer matters."""

    def start(self) -> Any: ...
    def unknown(self) -> list[Any]: ...
    def step(self, state: Any, row: tuple) -> Any: ...


def fold_ordered(rows: DataFrame, key: list[str], order: str, values: list[str], fold: Fold, outputs: list[tuple[str, str, pa.DataType]], result: Callable[[Any], tuple]) -> DataFrame:
    """(key, outputs): ``result`` of the state after each key's last row.

    Range partitions are folded side by side. Of a key that is cut by a partition's start, the rows up to the one where
    the past no longer matters are kept, and its state from there on; a second, short fold runs through these parts of
    a key. A fold that never forgets keeps its rows to the end and is still exact. Memory is one part's kept rows."""
    ship(rows.sparkSession)
    placed = ranged(rows.select(*key, order, *values), key, [order])
    kinds = {n: placed.schema[n].dataType.simpleString() for n in (*key, *values)}
    kept = f"array<struct<{', '.join(f'{n}:{kinds[n]}' for n in values)}>>"
    shape = ", ".join(f"{n} {kinds[n]}" for n in key) + f", __p long, kept {kept}, forgot boolean, state binary"
    n_key = len(key)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        now, states, before, first, out = None, [], [], True, []

        def done():
            out.append((*now[0], now[1], before, len(states) == 1, pickle.dumps(states[0])))

        for batch in batches:
            schema = pa.schema([*batch.schema][:n_key] + [pa.field("__p", pa.int64()), pa.field("kept", pa.list_(pa.struct([*batch.schema][n_key + 1 :]))), pa.field("forgot", pa.bool_()), pa.field("state", pa.binary())])
            for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                k, p, value = row[:n_key], row[n_key], row[n_key + 1 :]
                if now is None or k != now[0]:
                    if now is not None:
                        done()
                    # only a partition's first key can have begun before it
                    now, states, before = (k, p), fold.unknown() if first else [fold.start()], []
                    first = False
                if len(states) > 1:
                    before.append(dict(zip(values, value, strict=True)))
                states = [fold.step(s, value) for s in states]
                if len(states) > 1 and all(s == states[0] for s in states):
                    states = states[:1]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                out = []
        if now is not None:
            done()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        now, state, out = None, None, []

        def flush():
            columns = list(zip(*((*k, *result(s)) for k, s in out), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, *(o[2] for o in outputs)], strict=True)], [*key, *(o[0] for o in outputs)])

        for batch in batches:
            types = [batch.schema.field(c).type for c in range(n_key)]
            for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                k, (before, forgot, after) = row[:n_key], row[n_key + 1 :]
                if k != now:
                    if now is not None:
                        out.append((now, state))
                    now, state = k, fold.start()
                for r in before:
                    state = fold.step(state, tuple(r[v] for v in values))
                state = pickle.loads(after) if forgot else state
            if out:
                yield flush()
                out = []
        if now is not None:
            out.append((now, state))
            yield flush()

    cut = placed.select(*key, "__p", *values).mapInArrow(parts, shape)
    in_order = cut.repartition(*key).sortWithinPartitions(*key, "__p")
    return in_order.mapInArrow(through, ", ".join([*(f"{n} {kinds[n]}" for n in key), *(f"{n} {t}" for n, t, _ in outputs)]))
