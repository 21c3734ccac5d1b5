"""Constraints as queries: schema, keys, unique columns and references. Each gives the violations; none means valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.plans.model import Model


def schema_differences(model: Model, schema: T.StructType) -> list[str]:
    """Columns that are missing, extra or of another type or, for VARCHAR, length."""
    found, out = {f.name: f for f in schema}, []
    for f in model.fields:
        have = found.pop(f.name, None)
        if have is None:
            out.append(f"{f.name}: missing")
            continue
        declared = have.metadata.get("__CHAR_VARCHAR_TYPE_STRING")
        kind = declared or have.dataType.simpleString()
        want = f.spark.simpleString()
        if kind != want and not (want.startswith("varchar") and kind == "string" and declared is None):
            out.append(f"{f.name}: {kind} instead of {want}")
    return out + [f"{n}: extra" for n in found]


def duplicates(table: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, count) of values that occur more than once; rows with a NULL in them do not count, as in SQL."""
    rows = table.dropna(subset=columns)
    return rows.groupBy(*columns).agg(F.count("*").alias("count")).where("count > 1")


def missing_references(table: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """(column, count) of values without a row in the parent table."""
    used = table.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return used.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def null_keys(model: Model, table: DataFrame) -> DataFrame:
    """One row: how many rows have a NULL in a column that must not."""
    must = [f.name for f in model.fields if not f.nullable]
    return table.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in must))


def probe(table: DataFrame, columns: list[str]) -> T.StructType:
    """The columns' schema without reading rows; a missing column is an error."""
    return table.select(*columns).limit(0).schema


def table_exists(table: DataFrame, name: str) -> DataFrame:
    """One row with ``exists``: whether a catalog listing (table_name) has the table."""
    return table.agg((F.count_if(F.col("table_name") == name) > 0).alias("exists"))
