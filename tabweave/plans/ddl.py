"""Spark table definitions of models, in one fixed order: tables by name, then keys and indexes as table properties.

Spark's session catalog has no keys, references or indexes; they are kept as properties, and ``operators.checks``
verifies them with queries."""

from __future__ import annotations

import os
import tempfile

from tabweave.plans.model import Field, Model, Registry


def column_type(f: Field) -> str:
    return f.spark.simpleString().upper()


def create_table(model: Model, provider: str = "parquet") -> str:
    lines = []
    for f in model.fields:
        default = f" DEFAULT {f.options['default']}" if "default" in f.options else ""
        lines.append(f"  `{f.name}` {column_type(f)}{'' if f.nullable else ' NOT NULL'}{default}")
    properties = {"primary_key": ",".join(k.name for k in model.keys)}
    if model.auto:
        properties["auto"] = model.auto.name
    for f in model.fields:
        if "references" in f.options:
            properties[f"foreign_key.{f.name}"] = f.options["references"] + (f" ON DELETE {f.options['on_delete'].upper()}" if "on_delete" in f.options else "")
    for name, (unique, columns) in model.indexes().items():
        properties[f"{'unique' if unique else 'index'}.{name}"] = ",".join(columns)
    table = ".".join(f"`{p}`" for p in model.table.split("."))
    props = ",\n".join(f"  '{k}' = '{v}'" for k, v in sorted(properties.items()))
    return f"CREATE TABLE {table} (\n" + ",\n".join(lines) + f"\n) USING {provider}\nTBLPROPERTIES (\n{props}\n)"


def script(registry: Registry, provider: str = "parquet") -> str:
    return ";\n\n".join(create_table(m, provider) for m in registry) + ";\n"


def write_atomic(path: str, text: str) -> None:
    """Replace a file in one step, so that readers see the old or the new text."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
