"""The filter language: a document of conditions becomes one boolean Column.

Filters are two-valued: a missing value fails a comparison and passes its negation. ``compile_filter`` returns by default
a Column for use in ``where``, in which NULL and false are alike, so comparisons stay in the plain form that a Parquet
scan takes as pushed filters. Under a negation, and with ``strict``, conditions are never NULL. Null and missing are the
same in typed data.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.errors import BadFilterError
from docengine.functions import paths, values

# Operators of the language.
COMPARE = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$regex", "$options", "$exists", "$not"}
LOGICAL = {"$and", "$or", "$nor", "$not"}
IGNORED = {"$comment", "$hint", "$maxTimeMS"}
RANGES = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def compile_filter(filter_: dict | None, schema: T.StructType, strict: bool = False) -> Column:
    """The condition of ``filter_`` on rows of ``schema``; none or {} takes all rows."""
    if filter_ is None:
        return F.lit(True)
    if not isinstance(filter_, dict):
        raise BadFilterError("a filter is a document")
    from docengine.functions import variant

    parts: list[Column] = []
    for key, value in filter_.items():
        if key in IGNORED:
            continue
        if key == "$not":
            if not isinstance(value, dict):
                raise BadFilterError("$not needs a document")
            parts.append(~compile_filter(value, schema, strict=True))
        elif key in LOGICAL:
            if not isinstance(value, list) or not all(isinstance(v, dict) for v in value):
                raise BadFilterError(f"{key} needs a list of filters")
            made = [compile_filter(v, schema, strict or key == "$nor") for v in value]
            parts.append(all_of(made) if key == "$and" else any_of(made) if key == "$or" else ~any_of(made))
        elif key.startswith("$"):
            raise BadFilterError(f"unknown operator {key}")
        elif variant.is_variant(schema) and key != "_id":
            parts.append(variant.condition(key, operators(value)))
        else:
            made = field_condition(key, operators(value), schema)
            parts.append(sure(made) if strict else made)
    return all_of(parts)


def operators(value: Any) -> dict[str, Any]:
    """A field's condition as operators; a plain value is an equality."""
    if isinstance(value, dict) and "$regularExpression" in value:
        inner = value["$regularExpression"]
        return {"$regex": inner.get("pattern", ""), "$options": inner.get("options", "")}
    if isinstance(value, dict) and any(k.startswith("$") for k in value):
        if values.is_wrapper(value):
            return {"$eq": values.plain(value)}
        ops = {k: v for k, v in value.items() if k not in IGNORED}
        for op in ops:
            if op not in COMPARE:
                raise BadFilterError(f"unknown operator {op}")
        if "$options" in ops and "$regex" not in ops:
            raise BadFilterError("$options needs $regex")
        if "$exists" in ops and not isinstance(ops["$exists"], bool):
            raise BadFilterError("$exists needs true or false")
        for op in ("$in", "$nin"):
            if op in ops and not isinstance(ops[op], list):
                raise BadFilterError(f"{op} needs a list")
        if "$not" in ops:
            if not isinstance(ops["$not"], dict):
                raise BadFilterError("$not needs operators")
            operators(ops["$not"])
        return ops
    return {"$eq": values.plain(value)}


def id_value(value: Any) -> Any:
    """A literal compared with a string ``_id``: numbers and booleans are spelt out."""
    value = values.plain(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(int(value)) if float(value).is_integer() else repr(float(value))
    if isinstance(value, list):
        return [id_value(v) for v in value]
    return value


def field_condition(path: str, ops: dict[str, Any], schema: T.StructType) -> Column:
    found = paths.resolve(schema, path)
    if path == "_id" and found is not None and paths.family(found.kind) == "string":
        ops = {op: id_value(v) if op not in ("$regex", "$options", "$exists", "$not") else v for op, v in ops.items()}
    if found is None:
        return F.lit(missing(ops))
    kind, at = found.kind, found.column
    if found.many or isinstance(kind, T.ArrayType):
        if found.many and isinstance(kind, T.ArrayType):
            at, kind = F.flatten(at), kind.elementType
        elif isinstance(kind, T.ArrayType):
            whole = {op: v for op, v in ops.items() if op in ("$eq", "$ne") and isinstance(v, list)}
            if whole and len(whole) == len(ops):
                return all_of([leaf(op, v, at, kind, ops) for op, v in whole.items()])
            kind = kind.elementType
        held = F.exists(at, lambda x: x.isNotNull() & sure(all_of([leaf(op, v, x, kind, ops) for op, v in ops.items() if op != "$options"])))
        if not missing(ops):
            return held
        present = sure(F.exists(at, lambda x: x.isNotNull()))
        return F.when(present, sure(held)).otherwise(True)
    return all_of([leaf(op, v, at, kind, ops) for op, v in ops.items() if op != "$options"])


def missing(ops: dict[str, Any]) -> bool:
    """Whether a row without the field passes."""

    def one(op: str, value: Any) -> bool:
        if op == "$eq":
            return value is None
        if op == "$ne":
            return value is not None
        if op == "$nin":
            return True
        if op == "$exists":
            return not value
        if op == "$not":
            return not missing(operators(value))
        return False

    return all(one(op, v) for op, v in ops.items() if op != "$options")


def leaf(op: str, value: Any, at: Column, kind: T.DataType, ops: dict[str, Any]) -> Column:
    """One operator on one value; only $ne, $nin, $exists and $not hold for a null one."""
    if op == "$exists":
        return at.isNotNull() if value else at.isNull()
    if op == "$not":
        inner = operators(value)
        return ~sure(all_of([leaf(o, v, at, kind, inner) for o, v in inner.items() if o != "$options"]))
    if op == "$regex":
        if paths.family(kind) != "string":
            return F.lit(False)
        return at.rlike(regex_of(value, ops.get("$options", "")))
    if op in ("$in", "$nin"):
        fit = [v for v in map(values.plain, value) if v is not None and alike(v, kind)]
        if op == "$in":
            return at.isin([python_value(v) for v in fit]) if simple(fit) and fit else any_of([at == values.literal(v, cast_to(v, kind)) for v in fit])
        inside = at.isin([python_value(v) for v in fit]) if simple(fit) and fit else any_of([at == values.literal(v, cast_to(v, kind)) for v in fit])
        return at.isNull() | ~sure(inside) if fit else F.lit(True)
    value = values.plain(value)
    if value is None:
        if op == "$eq":
            return at.isNull()
        return at.isNotNull() if op == "$ne" else F.lit(False)
    if not alike(value, kind):
        return F.lit(op == "$ne")
    right = values.literal(value, cast_to(value, kind))
    if op == "$eq":
        return at == right
    if op == "$ne":
        return ~at.eqNullSafe(right)
    if paths.family(kind) not in ("number", "string", "time"):
        return F.lit(False)
    return getattr(at, RANGES[op])(right)


def alike(value: Any, kind: T.DataType) -> bool:
    """Whether a value of this Python type can equal one of the column's type; comparisons never cross types."""
    return values.family(value) == paths.family(kind)


def cast_to(value: Any, kind: T.DataType) -> T.DataType | None:
    """Numbers compare as they are; other values take the column's type."""
    return None if isinstance(value, (int, float)) and not isinstance(value, bool) else kind


def simple(items: list) -> bool:
    return all(isinstance(v, (bool, int, float, str)) for v in items)


def python_value(value: Any) -> Any:
    return value


def regex_of(pattern: Any, options: str) -> str:
    """The Java pattern of a $regex condition."""
    if isinstance(pattern, dict):
        ops = operators(pattern)
        return regex_of(ops["$regex"], ops.get("$options", "") + (options or ""))
    if not isinstance(pattern, str):
        raise BadFilterError("$regex needs a string")
    flags = "".join(sorted(set(options or "")))
    if set(flags) - set("imsxu"):
        raise BadFilterError(f"unknown regex options {options!r}")
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            error = BadFilterError(f"bad pattern {pattern!r}")
            error.code = 51008
            raise error from e
    return f"(?{flags}){pattern}" if flags else pattern


def fields_used(filter_: dict | None) -> set[str]:
    """All paths that a filter names."""
    out: set[str] = set()
    for key, value in (filter_ or {}).items():
        if key in LOGICAL:
            for inner in value if isinstance(value, list) else [value]:
                out |= fields_used(inner)
        elif not key.startswith("$"):
            out.add(key)
    return out
