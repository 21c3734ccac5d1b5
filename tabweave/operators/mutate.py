"""Mutations as pure plans: a table and a change give the new table and the rows it touched.

A predicate touches a row only where it is true, so NULL counts as no. ``Snapshots`` commits a new table as a folder
of its own and then names it, so readers see one state or the other."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.plans.errors import InvalidArgument, UnsafeMutation
from tabweave.plans.expr import Assign, Truth, UseDefault, check_owner
from tabweave.plans.model import Model
from tabweave.plans.query import Query


@dataclass(frozen=True)
class Mutation:
    """``table`` after the change, ``touched`` rows (as they are now; as they were, for a delete)."""

    table: DataFrame
    touched: DataFrame

    def affected(self) -> DataFrame:
        return self.touched.agg(F.count("*").alias("affected"))


def _guarded(query: Query) -> Column:
    """The rows to touch; refuses a predicate that is missing or always true before it looks at columns."""
    if query.truth() is Truth.ALWAYS and not query.allow_all_:
        raise UnsafeMutation(f"{query.model.table}: no restricting predicate")
    predicate = query.predicate()
    return F.lit(True) if predicate is None else F.coalesce(predicate.column(), F.lit(False))


def update(query: Query, *assigns: Assign) -> Mutation:
    hit = _guarded(query)
    if not assigns:
        raise InvalidArgument("nothing to assign")
    check_owner(query.model.table, query.model.columns, ((a.table, a.name) for a in assigns))
    names = [a.name for a in assigns]
    if len(set(names)) < len(names):
        raise InvalidArgument("a column is assigned twice")
    kinds = dict(query.source.dtypes)
    new = {a.name: a.column().cast(kinds[a.name]) for a in assigns}
    table = query.source.select(*(F.when(hit, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in query.source.columns))
    return Mutation(table, query.source.where(hit).withColumns(new))


def delete(query: Query) -> Mutation:
    hit = _guarded(query)
    return Mutation(query.source.where(~hit), query.source.where(hit))


def update_by_key(query: Query, key: tuple, *assigns: Assign) -> Mutation:
    return update(query.by_key(*key), *assigns)


def delete_by_key(query: Query, key: tuple) -> Mutation:
    return delete(query.by_key(*key))


def create(model: Model, table: DataFrame, values: dict, *options: UseDefault, next_id: Callable[[], int] | None = None) -> Mutation:
    """Insert one row. An auto column gets ``next_id()`` (or one above the largest), a column under ``use_default`` its declared default; a value of zero is a value."""
    by_name = {f.name: f for f in model.fields}
    check_owner(model.table, model.columns, ((o.table, o.name) for o in options))
    left_out = {o.name for o in options}
    if wrong := [n for n in left_out if "default" not in by_name[n].options]:
        raise InvalidArgument(f"{wrong[0]} has no default")
    columns = []
    for f in model.fields:
        kind = table.schema[f.name].dataType
        if f.auto:
            new = next_id() if next_id else (table.agg(F.max(f.name)).first()[0] or 0) + 1
            value = F.lit(_in_range(int(new), kind.typeName(), f.name))
        elif f.name in left_out:
            value = F.expr(f.options["default"])
        elif f.name in values:
            value = F.lit(values[f.name])
        else:
            raise InvalidArgument(f"no value for {f.name}")
        columns.append(value.cast(kind).alias(f.name))
    row = table.sparkSession.range(1).select(*columns)
    return Mutation(table.select(*model.columns).unionByName(row), row)


_BITS = {"byte": 7, "short": 15, "integer": 31, "long": 63}


def _in_range(value: int, kind: str, name: str) -> int:
    if value > (1 << _BITS.get(kind, 63)) - 1:
        raise InvalidArgument(f"id {value} does not fit {name}")
    return value


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], update_columns: list[str]) -> Mutation:
    """Rows of ``changes`` by key: known keys take over ``update_columns`` only, new keys are inserted whole. Keys are unique on both sides."""
    old, new = table.alias("o"), changes.alias("n")
    joined = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    is_new, changed = F.col(f"o.{keys[0]}").isNull(), F.col(f"n.{keys[0]}").isNotNull()
    columns = [F.when(is_new | (changed & F.lit(c in update_columns)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in table.columns]
    return Mutation(joined.select(*columns), joined.where(changed).select(*columns))


class Snapshots:
    """A table as folders of data and numbered pointer files, of which the newest valid one counts.

    A pointer is created exclusively, so of two writers one gets the number and the other an error, and a reader sees
    the table before or after, never without a pointer. A pointer that names a transaction counts once the transaction's
    record exists. Works on any file system with an exclusive create."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _text(self, at) -> str:
        stream = self.fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, at, text: str) -> None:
        out = self.fs.create(at, False)
        out.writeBytes(text)
        out.close()

    def _numbers(self) -> list[int]:
        """Numbers of the pointers, newest first."""
        if not self.fs.exists(self._at("")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._at(""))]
        return sorted((int(n[8:]) for n in names if n.startswith("POINTER-")), reverse=True)

    def _current(self) -> str | None:
        for n in self._numbers():
            name, _, record = self._text(self._at(f"POINTER-{n:016d}")).partition(" ")
            if name and (not record or self.fs.exists(self._jvm.org.apache.hadoop.fs.Path(record))):
                return name
        return None

    def read(self) -> DataFrame:
        name = self._current()
        if name is None:
            raise InvalidArgument(f"{self.path} has no snapshot yet")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def stage(self, table: DataFrame) -> str:
        """Write data that no pointer names yet."""
        name = f"v{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{name}")
        return name

    def point_to(self, name: str, record: str = "") -> None:
        self._create(self._at(f"POINTER-{next(iter(self._numbers()), 0) + 1:016d}"), f"{name} {record}".strip())

    def commit(self, table: DataFrame) -> None:
        self.point_to(self.stage(table))


class SilentRollback(Exception):
    """Raised by a handler to undo everything without an error."""


def transaction(tables: dict[str, Snapshots], handler: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> bool:
    """Give the handler the tables' states and commit what it returns as one: all tables change or none.

    Data is staged first; then each table gets a pointer that waits for the transaction's record; creating that one file
    commits. An error before it leaves every table as it was, and pointers that wait for ever are passed over. True if
    committed; a handler that raises SilentRollback gives False."""
    try:
        changed = handler({n: s.read() for n, s in tables.items()})
    except SilentRollback:
        return False
    if not changed:
        return True
    staged = {n: tables[n].stage(df) for n, df in changed.items()}
    first = tables[min(staged)]
    record = first._at(f"COMMIT-{uuid.uuid4().hex}")
    for n, name in staged.items():
        tables[n].point_to(name, record.toString())
    first._create(record, " ".join(sorted(staged)))
    return True
