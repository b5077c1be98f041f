"""Arrays, maps, JSON and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(df_schema: T.StructType, column: str, drop: tuple[str, ...]) -> Column:
    """A struct as JSON with sorted keys and without the dropped ones, at every depth of its declared type."""

    def build(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[build(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in drop])
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(value, lambda x: build(x, kind.elementType))
        return value

    return F.to_json(build(F.col(column), df_schema[column].dataType), {"ignoreNullFields": "false"})


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def state_key(source: Column, target: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", source, target).cast("binary"), 256), F.lit(16))


def incomplete(items: Column, *required: str) -> Column:
    """Whether an element lacks a required field."""
    return F.exists(items, lambda e: _any_null(e, required))


def _any_null(e: Column, required: tuple[str, ...]) -> Column:
    out = e[required[0]].isNull()
    for name in required[1:]:
        out = out | e[name].isNull()
    return out


def joined_notes(*lists: Column) -> Column:
    return F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])


def reversed_map(entries: Column) -> Column:
    """value -> key of an array of (key, value); of equal values the first key stays."""
    values = F.transform(entries, lambda e: e["value"])
    seen = F.filter(entries, lambda e, i: F.array_position(values, e["value"]) == i + 1)
    return F.map_from_entries(F.transform(seen, lambda e: F.struct(e["value"], e["key"])))


def grid(cells: Column, columns: Column) -> Column:
    """A row-major array of arrays from flat cells."""
    flat = cells
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(flat) - 1) / columns).cast("int")), lambda r: F.slice(flat, (r * columns + 1).cast("int"), columns.cast("int")))


def padded(rows: Column, fill: str = "") -> Column:
    """Ragged rows filled up to the widest."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(fill), width - F.size(r))))
