"""Named resources of a process, and sources that come up all together or not at all."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tabweave.plans.errors import InvalidArgument


class Resources:
    """Typed values by name. ``get_or_create`` makes a value once, however many threads ask; ``close`` ends all, newest first."""

    def __init__(self):
        self._values: dict[tuple[type, str], Any] = {}
        self._lock = threading.RLock()
        self._closed = False

    def set(self, name: str, value: Any) -> None:
        with self._lock:
            self._open()
            if (type(value), name) in self._values:
                raise InvalidArgument(f"{name} is set already")
            self._values[type(value), name] = value

    def get(self, kind: type, name: str) -> Any:
        with self._lock:
            for (have, known), value in self._values.items():
                if known == name and issubclass(have, kind):
                    return value
        raise InvalidArgument(f"no {kind.__name__} named {name}")

    def get_or_create(self, kind: type, name: str, make: Callable[[], Any]) -> Any:
        with self._lock:
            self._open()
            try:
                return self.get(kind, name)
            except InvalidArgument:
                self.set(name, value := make())
                return value

    def _open(self) -> None:
        if self._closed:
            raise InvalidArgument("resources are closed")

    def close(self) -> None:
        with self._lock:
            self._closed, errors = True, []
            for (_, name), value in reversed(self._values.items()):
                try:
                    getattr(value, "close", lambda: None)()
                except Exception as e:
                    errors.append(f"{name}: {e}")
            self._values.clear()
        if errors:
            raise RuntimeError("; ".join(errors))


#: Format to the options that a source of it must have.
NEEDED = {"parquet": ("path",), "orc": ("path",), "csv": ("path",), "json": ("path",), "jdbc": ("url", "dbtable"), "kafka": ("kafka.bootstrap.servers", "subscribe"), "table": ("name",)}
JDBC_URLS = {"mysql": "jdbc:mysql://{host}:{port}/{database}", "postgres": "jdbc:postgresql://{host}:{port}/{database}"}


def jdbc_options(kind: str, host: str, port: int, database: str, table: str, user: str, password: str, column: str | None = None, low: int = 0, high: int = 0, partitions: int = 1) -> dict[str, str]:
    """Options of a database table; with a numeric ``column`` and its range, Spark reads ``partitions`` parts side by side."""
    if kind not in JDBC_URLS:
        raise InvalidArgument(f"unknown database {kind}")
    out = {"format": "jdbc", "url": JDBC_URLS[kind].format(host=host, port=port, database=database), "dbtable": table, "user": user, "password": password}
    return out | ({"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)} if column else {})


def prepare(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """One source as a lazy DataFrame; a format without its connector on the class path says so."""
    options = dict(options)
    kind = options.pop("format", "parquet")
    if kind not in NEEDED:
        raise InvalidArgument(f"unknown format {kind}")
    if missing := [n for n in NEEDED[kind] if not options.get(n)]:
        raise InvalidArgument(f"a {kind} source needs {missing}")
    if kind == "table":
        return spark.table(options["name"])
    return spark.read.format(kind).options(**options).load()


def register_all(spark: SparkSession, sources: dict[str, dict[str, str]]) -> list[str]:
    """Prepare every source in order of name, then register all as views; if one fails none is registered."""
    ready = [(name, prepare(spark, sources[name])) for name in sorted(sources)]
    done: list[str] = []
    try:
        for name, df in ready:
            df.createOrReplaceTempView(name)
            done.append(name)
    except Exception:
        for name in reversed(done):
            spark.catalog.dropTempView(name)
        raise
    return done
