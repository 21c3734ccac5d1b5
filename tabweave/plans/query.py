"""Immutable queries on one model. Every builder call gives a new query; every terminal is one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabweave.plans.errors import InvalidArgument, NoRows
from tabweave.plans.expr import And, Compare, Expr, Order, Truth, check_owner
from tabweave.plans.model import Model, Registry


@dataclass(frozen=True)
class Query:
    model: Model
    source: DataFrame
    predicates: tuple[Expr, ...] = ()
    orders: tuple[Order, ...] = ()
    limit_: int | None = None
    offset_: int | None = None
    allow_all_: bool = False

    def where(self, *predicates: Expr) -> Query:
        return replace(self, predicates=self.predicates + predicates)

    def order(self, *orders: Order) -> Query:
        return replace(self, orders=self.orders + orders)

    def limit(self, n: int) -> Query:
        return replace(self, limit_=n)

    def offset(self, n: int) -> Query:
        return replace(self, offset_=n)

    def allow_all(self) -> Query:
        return replace(self, allow_all_=True)

    def predicate(self) -> Expr | None:
        """The conjunction of all predicates, checked against the model; None without any."""
        whole = And(*self.predicates)
        check_owner(self.model.table, self.model.columns, whole.owners())
        return whole if self.predicates else None

    def truth(self) -> Truth:
        return And(*self.predicates).truth()

    def filtered(self) -> DataFrame:
        predicate = self.predicate()
        return self.source if predicate is None else self.source.where(predicate.column())

    def all(self) -> DataFrame:
        """All rows and the model's columns in order."""
        for n, what in ((self.limit_, "limit"), (self.offset_, "offset")):
            if n is not None and n < 0:
                raise InvalidArgument(f"{what} {n} is negative")
        if any(o is None for o in self.orders):
            raise InvalidArgument("an order is missing")
        check_owner(self.model.table, self.model.columns, ((o.table, o.name) for o in self.orders))
        out = self.filtered().select(*self.model.columns)
        if self.orders:
            out = out.orderBy(*(o.column() for o in self.orders))
        if self.offset_ is not None:
            out = out.offset(self.offset_)
        return out if self.limit_ is None else out.limit(self.limit_)

    def first(self) -> DataFrame:
        """One row at most: replaces a limit, keeps an offset."""
        return self.limit(1).all()

    def one(self) -> Row:
        rows = self.first().collect()
        if not rows:
            raise NoRows(self.model.table)
        return rows[0]

    def count(self) -> DataFrame:
        """One row with ``count``; only the predicates matter."""
        return self.filtered().agg(F.count("*").alias("count"))

    def exists(self) -> DataFrame:
        """One row with ``exists``; stops at the first match."""
        return self.filtered().limit(1).agg((F.count("*") > 0).alias("exists"))

    def by_key(self, *values: Any) -> Query:
        keys = self.model.keys
        if len(values) != len(keys) or any(v is None for v in values):
            raise InvalidArgument(f"{self.model.table} has {len(keys)} key columns")
        return self.where(*(Compare(self.model.table, k.name, "=", (v,)) for k, v in zip(keys, values, strict=True)))

    def get(self, *values: Any) -> DataFrame:
        return self.by_key(*values).first()

    def reload(self, row: Row) -> Row:
        """The row's present state, by its key."""
        return self.by_key(*(row[k.name] for k in self.model.keys)).one()


class Catalog:
    """Entry point: queries on the models of a registry. ``reader`` maps a table name to a DataFrame; ``bind`` swaps it."""

    def __init__(self, spark: SparkSession, registry: Registry, reader=None):
        self.spark, self.registry = spark, registry
        self.reader = reader or spark.table

    def bind(self, reader) -> Catalog:
        return Catalog(self.spark, self.registry, reader)

    def query(self, table: str) -> Query:
        model = self.registry.models.get(table)
        if model is None:
            raise InvalidArgument(f"no model for table {table}")
        source = self.reader(table)
        if missing := [c for c in model.columns if c not in source.columns]:
            raise InvalidArgument(f"{table} lacks columns {missing}")
        return Query(model, source)

    def __getattr__(self, name: str) -> Query:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.query(name)
