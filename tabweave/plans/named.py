"""Named SQL blocks: a file of ``-- name: X`` blocks, declared parameters and a result mode, run by Spark SQL.

The text goes to Spark as it is but for list parameters, which become one marker per value. Joins, aggregates and
windows in such blocks are Spark's, not this package's."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tabweave.plans.errors import InvalidArgument, InvalidModel, NoRows

_MARK = re.compile(r"^[ \t]*--[ \t]*name:[ \t]*([A-Za-z_][A-Za-z0-9_]*)[ \t]*$")
#: Quoted text, comments, casts and parameters, in the order in which they are tried.
_TOKEN = re.compile(r"""(?P<quoted>'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<note>--[^\n]*|/\*.*?\*/)|(?P<cast>::)|:(?P<param>[A-Za-z_][A-Za-z0-9_]*)|(?P<open>['"`]|/\*)""", re.S)


def parse_blocks(text: str) -> dict[str, str]:
    """Name to SQL. Only comments may stand before the first marker; empty and repeated blocks are errors."""
    blocks: dict[str, list[str]] = {}
    name = None
    for line in text.splitlines():
        if mark := _MARK.match(line):
            name = mark[1]
            if name in blocks:
                raise InvalidModel(f"block {name} is there twice")
            blocks[name] = []
        elif name is None:
            if line.strip() and not line.strip().startswith("--"):
                raise InvalidModel("text before the first block")
        else:
            blocks[name].append(line)
    out = {k: "\n".join(v).strip() for k, v in blocks.items()}
    if empty := [k for k, v in out.items() if not v]:
        raise InvalidModel(f"block {empty[0]} is empty")
    return out


def parameters(sql: str) -> list[str]:
    """Names of ``:name`` outside quotes, comments and casts, in order of first use."""
    found: dict[str, None] = {}
    for m in _TOKEN.finditer(sql):
        if m["open"]:
            raise InvalidModel(f"unterminated {m['open']} in SQL")
        if m["param"]:
            found[m["param"]] = None
    return list(found)


def is_query(sql: str) -> bool:
    """SELECT or WITH at the start, or RETURNING between spaces; a comment in front hides the first two."""
    upper = sql.strip().upper()
    return upper.startswith(("SELECT", "WITH")) or " RETURNING " in upper


class Mode(Enum):
    EXEC = "exec"
    ROWS_AFFECTED = "rows_affected"
    MANY = "many"
    ONE = "one"


@dataclass(frozen=True)
class Declared:
    """What a caller declares of a block."""

    mode: Mode
    params: tuple[str, ...] = ()


def expand(sql: str, args: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """List arguments as one marker per element: ``IN (:ids)`` becomes ``IN (:ids_0, :ids_1)``; an empty list is an error."""
    flat: dict[str, Any] = {}

    def marker(m: re.Match) -> str:
        name = m["param"]
        if not name or not isinstance(args[name], (list, tuple)):
            if name:
                flat[name] = args[name]
            return m[0]
        if not args[name]:
            raise InvalidArgument(f"parameter {name} is an empty list")
        markers = []
        for i, v in enumerate(args[name]):
            key = f"{name}_{i}"
            while key in args:
                key += "_"
            flat[key] = v
            markers.append(f":{key}")
        return ", ".join(markers)

    return _TOKEN.sub(marker, sql), flat


class NamedQueries:
    """Blocks and their declarations, which match one to one; ``run`` by name."""

    def __init__(self, spark: SparkSession, text: str, declared: dict[str, Declared]):
        self.spark, self.blocks, self.declared = spark, parse_blocks(text), declared
        if odd := sorted(self.blocks.keys() ^ declared.keys()):
            raise InvalidModel(f"block and declaration do not match: {odd}")
        for name, sql in self.blocks.items():
            used, said = set(parameters(sql)), set(declared[name].params)
            if used != said:
                raise InvalidModel(f"{name}: parameters {sorted(used)} in SQL, {sorted(said)} declared")
            mode = declared[name].mode
            if mode is Mode.ROWS_AFFECTED and is_query(sql) or mode in (Mode.MANY, Mode.ONE) and not is_query(sql):
                raise InvalidModel(f"{name}: {mode.value} does not fit its SQL")

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, declared: dict[str, Declared]) -> NamedQueries:
        return cls(spark, Path(path).read_text(encoding="utf-8"), declared)

    def run(self, name: str, affected: Callable[[str, dict], int] | None = None, **args: Any) -> DataFrame | int | None:
        """MANY and ONE give a DataFrame; EXEC runs and gives nothing; ROWS_AFFECTED asks ``affected`` (Spark's tables here do not count rows)."""
        if name not in self.blocks:
            raise InvalidArgument(f"no block {name}")
        if args.keys() != set(self.declared[name].params):
            raise InvalidArgument(f"{name} takes {sorted(self.declared[name].params)}")
        sql, flat = expand(self.blocks[name], args)
        mode = self.declared[name].mode
        if mode is Mode.ROWS_AFFECTED:
            if affected is None:
                raise InvalidArgument(f"{name}: give a function that runs the statement and counts rows")
            return affected(sql, flat)
        out = self.spark.sql(sql, args=flat)
        if mode is Mode.EXEC:  # Spark runs commands at once; a query runs here, and its rows are not kept
            if is_query(sql):
                out.write.format("noop").mode("overwrite").save()
            return None
        return out.limit(1) if mode is Mode.ONE else out

    def one(self, name: str, **args: Any):
        rows = self.run(name, **args).collect()
        if not rows:
            raise NoRows(name)
        return rows[0]
