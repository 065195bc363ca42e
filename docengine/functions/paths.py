"""Dotted paths over nested schemas.

A path walks structs and maps by name. In ``any`` mode it also walks arrays and stands for all leaves below them; in
``strict`` mode an array ends it. A numeric part is a name, not a position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass
class Leaves:
    """What a path stands for: one value, or with ``many`` an array of leaves; ``kind`` is the type of a leaf."""

    column: Column
    kind: T.DataType
    many: bool


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def family(kind: T.DataType) -> str:
    if isinstance(kind, NUMERIC):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, TIMES):
        return "time"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.NullType):
        return "null"
    return "other"


def field_of(schema: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in schema.fields if f.name == name), None)


def _part(name: str):
    return lambda x: x[name]


def resolve(schema: T.StructType, path: str, mode: str = "any") -> Leaves | None:
    """The leaves of ``path``, or None where the schema has no such path (every row lacks it)."""
    head, *rest = path.split(".")
    field = field_of(schema, head)
    if field is None:
        whole = field_of(schema, path)  # a name that has a dot in it
        return Leaves(column(path), whole.dataType, False) if whole is not None else None
    at, kind, many = column(head), field.dataType, False
    for name in rest:
        while isinstance(kind, T.ArrayType):
            if mode == "strict":
                return None
            at, many, kind = (F.flatten(at) if many else at), True, kind.elementType
        if isinstance(kind, T.StructType):
            found = field_of(kind, name)
            if found is None:
                return None
            kind = found.dataType
        elif isinstance(kind, T.MapType):
            kind = kind.valueType
        else:
            return None
        at = F.transform(at, _part(name)) if many else at[name]
    return Leaves(at, kind, many)


def strict(schema: T.StructType, path: str) -> Column:
    """The value at ``path`` without walking arrays; null where there is none."""
    found = resolve(schema, path, "strict")
    return found.column if found is not None else F.lit(None)


def strict_type(schema: T.StructType, path: str) -> T.DataType | None:
    found = resolve(schema, path, "strict")
    return found.kind if found is not None else None
