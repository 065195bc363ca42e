"""Python and extended-JSON values as literals."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.errors import BadFilterError


# The keys of extended-JSON wrappers.
WRAPPERS = {"$oid", "$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$date", "$binary"}


def is_wrapper(value: Any) -> bool:
    return isinstance(value, dict) and len(value) == 1 and set(value) <= WRAPPERS


def plain(value: Any) -> Any:
    """``value`` with extended-JSON wrappers taken off."""
    if isinstance(value, dict) and len(value) == 1:
        key, inner = next(iter(value.items()))
        if key == "$oid":
            return str(inner)
        if key == "$numberLong":
            return int(inner)
        if key in ("$numberInt", "$numberDouble"):
            return float(inner) if key == "$numberDouble" else int(inner)
        if key == "$numberDecimal":
            return decimal.Decimal(str(inner))
        if key == "$date":
            if isinstance(inner, (int, float)):
                return dt.datetime.fromtimestamp(inner / 1000, dt.UTC).replace(tzinfo=None)
            if isinstance(inner, dict):
                return plain({"$date": plain(inner)})
            return dt.datetime.fromisoformat(str(inner).replace("Z", "+00:00")).astimezone(dt.UTC).replace(tzinfo=None)
        if key == "$binary":
            return base64.b64decode(inner["base64"] if isinstance(inner, dict) else inner)
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def family(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (dt.datetime, dt.date)):
        return "time"
    if isinstance(value, list):
        return "array"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, bytes):
        return "other"
    raise BadFilterError(f"unsupported value {value!r}")


def literal(value: Any, kind: T.DataType | None = None) -> Column:
    """``value`` as a Column, of type ``kind`` if given."""
    value = plain(value)
    if isinstance(value, list):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else None
        made = F.array(*(literal(v, inner) for v in value))
    elif isinstance(value, dict):
        types = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
        names = list(types) if types else list(value)
        made = F.struct(*(literal(value.get(n), types.get(n)).alias(n) for n in names)) if names else F.lit(None)
    elif isinstance(value, dt.datetime):
        made = F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    else:
        made = F.lit(value)
    return made.cast(kind) if kind is not None and not isinstance(kind, T.NullType) else made


def type_of(value: Any) -> T.DataType:
    """The column type that a Python value asks for."""
    value = plain(value)
    kinds = {"null": T.NullType(), "bool": T.BooleanType(), "string": T.StringType(), "time": T.TimestampNTZType(), "other": T.BinaryType()}
    what = family(value)
    if what == "number":
        return T.LongType() if isinstance(value, int) else T.DoubleType()
    if what == "array":
        return T.ArrayType(type_of(next((v for v in value if v is not None), None)))
    if what == "object":
        return T.StructType([T.StructField(k, type_of(v)) for k, v in value.items()])
    return kinds[what]
