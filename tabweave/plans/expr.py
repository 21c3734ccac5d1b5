"""Predicates, assignments and orders as small immutable trees that know their table.

They are checked in Python (ownership, static truth) and lowered to Spark columns, so filters reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabweave.plans.errors import InvalidArgument, UnknownColumn


class Truth(Enum):
    ALWAYS = 1
    NEVER = 0
    DEPENDS = 2


class Expr:
    """A predicate; ``&``, ``|`` and ``~`` combine it."""

    def column(self) -> Column:
        raise NotImplementedError

    def truth(self) -> Truth:
        return Truth.DEPENDS

    def owners(self) -> Iterable[tuple[str, str]]:
        return ()

    def __and__(self, other: Expr) -> Expr:
        return And(self, other)

    def __or__(self, other: Expr) -> Expr:
        return Or(self, other)

    def __invert__(self) -> Expr:
        return Not(self)


_COMPARE = {"=": lambda c, v: c == v, "<>": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "like": lambda c, v: c.like(v)}


@dataclass(frozen=True)
class Compare(Expr):
    """column op values; ``in`` of nothing is false and ``not in`` of nothing true, also for NULL."""

    table: str
    name: str
    op: str
    values: tuple

    def column(self) -> Column:
        c, v = F.col(f"`{self.name}`"), self.values
        if self.op in _COMPARE:
            return _COMPARE[self.op](c, F.lit(v[0]) if self.op != "like" else v[0])
        if self.op == "between":
            return c.between(F.lit(v[0]), F.lit(v[1]))
        if self.op in ("in", "not in"):
            if not v:
                return F.lit(self.op == "not in")
            return c.isin(*v) if self.op == "in" else ~c.isin(*v)
        return c.isNull() if self.op == "is null" else c.isNotNull()

    def truth(self) -> Truth:
        if self.op in ("in", "not in") and not self.values:
            return Truth.NEVER if self.op == "in" else Truth.ALWAYS
        return Truth.DEPENDS

    def owners(self):
        return ((self.table, self.name),)


class Group(Expr):
    """All (And) or any (Or) of its parts; without parts true, or false."""

    all_of: bool

    def __init__(self, *parts: Expr):
        if any(p is None for p in parts):
            raise InvalidArgument("a predicate is missing")
        self.parts = parts

    def column(self) -> Column:
        columns = [p.column() for p in self.parts]
        return reduce((lambda a, b: a & b) if self.all_of else (lambda a, b: a | b), columns) if columns else F.lit(self.all_of)

    def truth(self) -> Truth:
        seen = {p.truth() for p in self.parts}
        end, rest = (Truth.NEVER, Truth.ALWAYS) if self.all_of else (Truth.ALWAYS, Truth.NEVER)
        return end if end in seen else Truth.DEPENDS if Truth.DEPENDS in seen else rest

    def owners(self):
        return (o for p in self.parts for o in p.owners())


class And(Group):
    all_of = True


class Or(Group):
    all_of = False


class Not(Expr):
    def __init__(self, part: Expr):
        if part is None:
            raise InvalidArgument("a predicate is missing")
        self.part = part

    def column(self) -> Column:
        return ~self.part.column()

    def truth(self) -> Truth:
        return {Truth.ALWAYS: Truth.NEVER, Truth.NEVER: Truth.ALWAYS}.get(self.part.truth(), Truth.DEPENDS)

    def owners(self):
        return self.part.owners()


@dataclass(frozen=True)
class Assign:
    """column = value, column + value, column - value or NULL."""

    table: str
    name: str
    op: str
    value: Any = None

    def column(self) -> Column:
        c = F.col(f"`{self.name}`")
        return {"set": lambda: F.lit(self.value), "add": lambda: c + F.lit(self.value), "sub": lambda: c - F.lit(self.value), "null": lambda: F.lit(None)}[self.op]()


@dataclass(frozen=True)
class Order:
    """Where NULLs go follows the sort order by default: last if ascending, first if descending; ``nulls`` turns it."""

    table: str
    name: str
    descending: bool = False
    nulls: str = ""

    def column(self) -> Column:
        c, last = F.col(f"`{self.name}`"), (self.nulls or ("first" if self.descending else "last")) == "last"
        if self.descending:
            return c.desc_nulls_last() if last else c.desc_nulls_first()
        return c.asc_nulls_last() if last else c.asc_nulls_first()


@dataclass(frozen=True)
class UseDefault:
    """On insert: leave this column to its declared default."""

    table: str
    name: str


@dataclass(frozen=True)
class TypedColumn:
    """What every column can do; subclasses add what their kind can."""

    table: str
    name: str

    def _compare(self, op: str, *values) -> Compare:
        if any(v is None for v in values):
            raise InvalidArgument(f"{self.name}: compare with NULL by is_null")
        return Compare(self.table, self.name, op, values)

    def eq(self, value) -> Expr:
        return self._compare("=", value)

    def ne(self, value) -> Expr:
        return self._compare("<>", value)

    def in_(self, *values) -> Expr:
        return self._compare("in", *values)

    def not_in(self, *values) -> Expr:
        return self._compare("not in", *values)

    def set(self, value) -> Assign:
        return Assign(self.table, self.name, "set", value)

    def asc(self, nulls: str = "") -> Order:
        return Order(self.table, self.name, False, nulls)

    def desc(self, nulls: str = "") -> Order:
        return Order(self.table, self.name, True, nulls)


class _Ordered:
    def gt(self, value) -> Expr:
        return self._compare(">", value)

    def gte(self, value) -> Expr:
        return self._compare(">=", value)

    def lt(self, value) -> Expr:
        return self._compare("<", value)

    def lte(self, value) -> Expr:
        return self._compare("<=", value)

    def between(self, low, high) -> Expr:
        return self._compare("between", low, high)


class _Like:
    def like(self, pattern: str) -> Expr:
        return self._compare("like", pattern)


class _Number:
    def add(self, value) -> Assign:
        return Assign(self.table, self.name, "add", value)

    def sub(self, value) -> Assign:
        return Assign(self.table, self.name, "sub", value)


class _Nullable:
    def is_null(self) -> Expr:
        return Compare(self.table, self.name, "is null", ())

    def is_not_null(self) -> Expr:
        return Compare(self.table, self.name, "is not null", ())

    def set_null(self) -> Assign:
        return Assign(self.table, self.name, "null")


class _Default:
    def use_default(self) -> UseDefault:
        return UseDefault(self.table, self.name)


_BY_KIND = {"integer": (_Number, _Ordered), "float": (_Number, _Ordered), "string": (_Ordered, _Like), "time": (_Ordered,)}


def column_for(table: str, name: str, kind: str, nullable: bool = False, default: bool = False) -> TypedColumn:
    """A column with the abilities of its kind; an empty ``table`` fits any model by name."""
    extra = (*_BY_KIND.get(kind, ()), *((_Nullable,) if nullable else ()), *((_Default,) if default else ()))
    return type("Column", (*extra, TypedColumn), {})(table, name)


def check_owner(table: str, columns: list[str], used: Iterable[tuple[str, str]]) -> None:
    for owner, name in used:
        if owner not in ("", table) or name not in columns:
            raise UnknownColumn(f"{owner or '?'}.{name} is no column of {table}")
