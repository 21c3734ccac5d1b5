"""Models: typed columns with keys, defaults, indexes and references, written as tag strings.

A tag is ``name=value;flag``; see ``OPTIONS``. A model becomes a Spark schema whose VARCHAR lengths and nullability
Spark itself enforces on tables, plus metadata (keys, references) that ``operators.checks`` verifies with queries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

from tabweave.plans.errors import InvalidModel
from tabweave.plans.expr import TypedColumn, column_for

OPTIONS = {"pk", "auto", "null", "notnull", "size", "precision", "scale", "default", "index", "unique", "references", "on_delete", "spark_type"}
FLAGS = ("pk", "auto", "null", "notnull")
ON_DELETE = {"CASCADE", "RESTRICT", "SET NULL", "NO ACTION"}
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class Kind(Enum):
    STRING = "string"
    BOOL = "bool"
    INTEGER = "integer"
    FLOAT = "float"
    TIME = "time"
    BYTES = "bytes"
    JSON = "json"
    OTHER = "other"


#: Type names and what they are in Spark; unsigned ones are widened.
TYPES: dict[str, tuple[Kind, T.DataType]] = {
    "string": (Kind.STRING, T.StringType()), "bool": (Kind.BOOL, T.BooleanType()),
    "int8": (Kind.INTEGER, T.ByteType()), "int16": (Kind.INTEGER, T.ShortType()), "int32": (Kind.INTEGER, T.IntegerType()), "int64": (Kind.INTEGER, T.LongType()), "int": (Kind.INTEGER, T.LongType()),
    "uint8": (Kind.INTEGER, T.ShortType()), "uint16": (Kind.INTEGER, T.IntegerType()), "uint32": (Kind.INTEGER, T.LongType()), "uint64": (Kind.INTEGER, T.DecimalType(20, 0)), "uint": (Kind.INTEGER, T.DecimalType(20, 0)),
    "float32": (Kind.FLOAT, T.FloatType()), "float64": (Kind.FLOAT, T.DoubleType()), "time": (Kind.TIME, T.TimestampType()), "time_ntz": (Kind.TIME, T.TimestampNTZType()),
    "bytes": (Kind.BYTES, T.BinaryType()), "json": (Kind.JSON, T.StringType()),
}


def identifier(what: str, value: str) -> str:
    if not _IDENTIFIER.fullmatch(value):
        raise InvalidModel(f"{what} {value!r} is not an identifier")
    return value


def parse_tag(tag: str) -> dict[str, str]:
    """``a=b;c`` as {a: b, c: true}; empty and repeated names are errors."""
    out: dict[str, str] = {}
    for item in filter(None, (x.strip() for x in tag.split(";"))):
        name, found, value = item.partition("=")
        name = name.strip()
        if not name or name in out:
            raise InvalidModel(f"{'repeated' if name else 'empty'} option in {tag!r}")
        out[name] = value.strip() if found else "true"
    return out


def _positive(options: dict[str, str], name: str) -> int:
    raw = options.get(name, "")
    if raw and not (raw.isdigit() and int(raw) > 0):
        raise InvalidModel(f"{name} must be a positive number, not {raw!r}")
    return int(raw or 0)


@dataclass(frozen=True)
class Field:
    """One column. ``nullable`` comes from a ``?`` after the type name, or the null and notnull options."""

    name: str
    kind: Kind
    spark: T.DataType
    nullable: bool
    options: dict[str, str] = field(hash=False)

    @classmethod
    def parse(cls, name: str, type_name: str, tag: str = "") -> Field:
        options = parse_tag(tag)
        if extra := sorted(options.keys() - OPTIONS):
            raise InvalidModel(f"column {name}: unsupported option {extra[0]!r}")
        for flag in FLAGS:
            if options.get(flag, "true") != "true":
                raise InvalidModel(f"column {name}: option {flag} takes no value")
        if "null" in options and "notnull" in options:
            raise InvalidModel(f"column {name}: null and notnull exclude each other")
        nullable = (type_name.endswith("?") or "null" in options) and "notnull" not in options
        base = type_name.rstrip("?")
        size, precision = _positive(options, "size"), _positive(options, "precision")
        scale = options.get("scale", "0")
        if not scale.isdigit() or ("scale" in options and (not precision or int(scale) > precision)):
            raise InvalidModel(f"column {name}: scale must lie between zero and precision")
        if "spark_type" in options:
            kind, spark = TYPES.get(base, (Kind.OTHER, None))[0], T.StructType.fromDDL(f"x {options['spark_type']}")[0].dataType
        elif base not in TYPES:
            raise InvalidModel(f"column {name}: type {base!r} needs spark_type")
        else:
            kind, spark = TYPES[base]
        if kind is Kind.FLOAT and precision and "spark_type" not in options:
            spark = T.DecimalType(precision, int(scale))
        if kind is Kind.STRING and size and "spark_type" not in options:
            spark = T.VarcharType(size)
        out = cls(identifier("column", name), kind, spark, nullable, options)
        out._check(base)
        return out

    def _check(self, base: str) -> None:
        o, name = self.options, self.name
        rules = (
            ("auto" in o and "pk" not in o, "auto needs pk"), ("pk" in o and self.nullable, "a primary key is not nullable"), ("auto" in o and "default" in o, "auto and default exclude each other"),
            ("pk" in o and "default" in o, "a primary key has no default"), ("on_delete" in o and "references" not in o, "on_delete needs references"),
            ("auto" in o and (self.kind is not Kind.INTEGER or base in ("uint", "uint64")), "auto needs an integer that fits 64 bits"),
            ("on_delete" in o and o["on_delete"].upper() not in ON_DELETE, "unsupported on_delete"), (o.get("on_delete", "").upper() == "SET NULL" and not self.nullable, "SET NULL needs a nullable column"),
        )
        for broken, why in rules:
            if broken:
                raise InvalidModel(f"column {name}: {why}")
        for what in ("index", "unique"):
            if what in o:
                identifier(what, o[what])
        if "references" in o and not re.fullmatch(r"([A-Za-z_]\w*\.)?[A-Za-z_]\w*\([A-Za-z_]\w*\)", o["references"]):
            raise InvalidModel(f"column {name}: references must be [schema.]table(column)")

    @property
    def primary(self) -> bool:
        return "pk" in self.options

    @property
    def auto(self) -> bool:
        return "auto" in self.options


@dataclass(frozen=True)
class Model:
    """A table: [schema.]name, columns in order, keys; columns are reached as ``model.c.name``."""

    table: str
    fields: tuple[Field, ...]

    @classmethod
    def of(cls, table: str, *columns: tuple, embed: tuple[tuple, ...] = ()) -> Model:
        """``columns`` are (name, type[, tag]); those of ``embed`` come first, flattened into the table."""
        for part in table.split("."):
            identifier("table", part)
        fields = tuple(Field.parse(*c) for c in (*embed, *columns))
        names = [f.name for f in fields]
        if len(set(names)) < len(names):
            raise InvalidModel(f"table {table}: a column is named twice")
        if not any(f.primary for f in fields):
            raise InvalidModel(f"table {table}: no primary key")
        autos = [f for f in fields if f.auto]
        if len(autos) > 1 or (autos and sum(f.primary for f in fields) > 1):
            raise InvalidModel(f"table {table}: an auto column is the only key")
        model = cls(table, fields)
        model.indexes()
        return model

    @property
    def keys(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.primary)

    @property
    def auto(self) -> Field | None:
        return next((f for f in self.fields if f.auto), None)

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def c(self) -> Columns:
        return Columns(self)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.spark, T.VarcharType) else f.spark, f.nullable) for f in self.fields])

    def indexes(self) -> dict[str, tuple[bool, list[str]]]:
        """Index name to (unique, columns); one name is of one kind."""
        out: dict[str, tuple[bool, list[str]]] = {}
        for f in self.fields:
            for what in ("index", "unique"):
                if name := f.options.get(what):
                    unique, columns = out.setdefault(name, (what == "unique", []))
                    if unique != (what == "unique"):
                        raise InvalidModel(f"index {name} is both unique and not")
                    columns.append(f.name)
        return dict(sorted(out.items()))


class Columns:
    def __init__(self, model: Model):
        self._model = model

    def __getattr__(self, name: str) -> TypedColumn:
        for f in self._model.fields:
            if f.name == name:
                return column_for(self._model.table, f.name, f.kind.value, f.nullable, "default" in f.options)
        raise AttributeError(f"{self._model.table} has no column {name}")


class Registry:
    """Models of one application: a table once, an index name once per schema."""

    def __init__(self, *models: Model):
        self.models: dict[str, Model] = {}
        self._indexes: set[tuple[str, str]] = set()
        for m in models:
            self.add(m)

    def add(self, model: Model) -> None:
        if model.table in self.models:
            raise InvalidModel(f"table {model.table} is declared twice")
        schema = model.table.rpartition(".")[0]
        for name in model.indexes():
            if (schema, name) in self._indexes:
                raise InvalidModel(f"index {name} is declared twice in schema {schema or 'default'}")
            self._indexes.add((schema, name))
        self.models[model.table] = model

    def __iter__(self):
        return iter(sorted(self.models.values(), key=lambda m: m.table))
