"""Heterogeneous collections: rows of ``_id STRING, doc VARIANT``.

A VARIANT cannot be compared, so a value is looked at by its type first: comparisons stay within one type, an explicit
null counts as present, and a missing field is told from it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.errors import BadFilterError
from docengine.functions import values


def is_variant(schema: T.StructType) -> bool:
    return {f.name for f in schema.fields} == {"_id", "doc"} and isinstance(schema["doc"].dataType, T.VariantType)


def from_json_rows(df: DataFrame, text: str = "json") -> DataFrame:
    """A variant collection of JSON documents in the column ``text``; ``_id`` is that of the document."""
    doc = F.try_parse_json(F.col(text))
    return df.select(F.try_variant_get(doc, "$._id", "string").alias("_id"), doc.alias("doc")).where("doc is not null")


def get(path: str, doc: str = "doc") -> Column:
    steps = "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))
    return F.try_variant_get(F.col(doc), "$" + steps, "variant")


def rank(v: Column) -> Column:
    """null < number < string < bool < other."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), 0)
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), 1)
        .when(kind == "STRING", 2)
        .when(kind == "BOOLEAN", 3)
        .otherwise(4)
    )


def key(path: str) -> Column:
    """A struct that can be compared, sorted and grouped in the engine's order of types."""
    return key_of(get(path))


def key_of(v: Column) -> Column:
    r = rank(v)
    number = F.when(r == 1, F.try_variant_get(v, "$", "double"))
    text = F.when(r >= 2, F.try_variant_get(v, "$", "string"))
    return F.struct(r.cast("tinyint").alias("rank"), number.alias("num"), F.coalesce(text, F.when(r == 4, F.to_json(v))).alias("str"))


def unsupported(what: str) -> BadFilterError:
    return BadFilterError(f"{what} is not supported on a heterogeneous collection")


def project(df: DataFrame, spec: Any) -> DataFrame:
    """``_id`` and the listed fields, each as a VARIANT column; documents are not made smaller."""
    names = list(spec) if isinstance(spec, (list, tuple)) else [k for k, v in spec.items() if v]
    if not isinstance(spec, (list, tuple)) and len([k for k, v in spec.items() if not v and k != "_id"]):
        raise unsupported("leaving out fields")
    keep_id = isinstance(spec, (list, tuple)) or bool(spec.get("_id", 1))
    return df.select(*(["_id"] if keep_id else []), *(get(n).alias(n) for n in dict.fromkeys(names) if n != "_id"))


def distinct(df: DataFrame, path: str) -> DataFrame:
    """Distinct values as JSON text; numbers that are equal are one; an array is unrolled one level."""
    v = get(path)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    values_ = df.where(v.isNotNull()).select(F.explode(items).alias("doc")).where(~F.is_variant_null("doc"))
    return values_.groupBy(key_of(F.col("doc")).alias("k")).agg(F.min(F.to_json("doc")).alias("value")).select("value")


def sorted_by(df: DataFrame, keys: list[tuple[str, int]]) -> list[Column]:
    """Order of $sort: missing and null last either way, ties by ``_id``."""
    out = []
    for path, way in keys:
        if path == "_id":
            out.append(F.col("_id").asc() if way == 1 else F.col("_id").desc())
            continue
        k = key(path)
        out += [(k["rank"] == 0).asc(), k.asc() if way == 1 else k.desc()]
    return [*out, F.col("_id").asc()]


def grouped(df: DataFrame, spec: dict) -> DataFrame:
    """$group by a path or constant with $sum, $avg, $min, $max, $count, $first and $last; ``_id`` and values that are not
    numbers of a sum are VARIANT. Values of other types than numbers do not add up."""
    at = spec["_id"]
    path = at[1:] if isinstance(at, str) and at.startswith("$") else None
    if path is None and at is not None:
        raise unsupported("grouping by anything but one field")
    made = []
    for name, accumulator in spec.items():
        if name == "_id":
            continue
        ((op, arg),) = accumulator.items()
        if op == "$count":
            made.append(F.count(F.lit(1)).alias(name))
            continue
        if isinstance(arg, str) and arg.startswith("$"):
            v, k = get(arg[1:]), key(arg[1:])
        elif op in ("$sum", "$avg") and isinstance(arg, (int, float)) and not isinstance(arg, bool):
            made.append((F.sum(F.lit(float(arg))) if op == "$sum" else F.avg(F.lit(float(arg)))).alias(name))
            continue
        else:
            raise unsupported(f"{op} of {arg!r}")
        if op == "$sum":
            made.append(F.coalesce(F.sum(k["num"]), F.lit(0.0)).alias(name))
        elif op == "$avg":
            made.append(F.avg(k["num"]).alias(name))
        elif op in ("$min", "$max"):
            made.append((F.min_by if op == "$min" else F.max_by)(v, F.when(k["rank"] > 0, k)).alias(name))
        elif op in ("$first", "$last"):
            made.append((F.min_by if op == "$first" else F.max_by)(v, F.col("_id")).alias(name))
        else:
            raise unsupported(op)
    if path is None:
        return df.groupBy(F.lit(None).cast("string").alias("_id")).agg(*(made or [F.count(F.lit(1)).alias("__n")])).drop("__n")
    return df.groupBy(key(path).alias("__k")).agg(F.min_by(get(path), F.col("_id")).alias("_id"), *made).drop("__k")


def condition(path: str, ops: dict[str, Any]) -> Column:
    """A field's condition, never NULL; an array's elements are tried one by one."""
    v = get(path)
    items = F.try_variant_get(v, "$", "array<variant>")
    is_array = sure(F.schema_of_variant(v).startswith("ARRAY"))
    from docengine.functions.filters import missing

    one = _value(v, ops)
    any_ = F.exists(items, lambda x: _value(x, ops))
    return F.when(v.isNull(), F.lit(missing(ops))).when(is_array, sure(any_)).otherwise(one)


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _value(v: Column, ops: dict[str, Any]) -> Column:
    from docengine.functions.filters import all_of

    return sure(all_of([_op(op, x, v, ops) for op, x in ops.items() if op != "$options"]))


def _op(op: str, value: Any, v: Column, ops: dict[str, Any]) -> Column:
    from docengine.functions.filters import any_of, operators, regex_of

    if op == "$exists":
        return F.lit(bool(value))
    if op == "$not":
        return ~_value(v, operators(value))
    if op == "$in":
        return any_of([_op("$eq", x, v, ops) for x in value])
    if op == "$nin":
        return ~sure(any_of([_op("$eq", x, v, ops) for x in value]))
    if op == "$ne":
        return ~sure(_op("$eq", value, v, ops))
    if op == "$regex":
        return (rank(v) == 2) & F.try_variant_get(v, "$", "string").rlike(regex_of(value, ops.get("$options", "")))
    value = values.plain(value)
    kind = values.family(value)
    if kind == "null":
        return F.is_variant_null(v) if op == "$eq" else F.lit(False)
    if kind == "number":
        right, left, want = F.lit(float(value)), F.try_variant_get(v, "$", "double"), 1
    elif kind == "string":
        right, left, want = F.lit(value), F.try_variant_get(v, "$", "string"), 2
    elif kind == "bool" and op == "$eq":
        right, left, want = F.lit(value), F.try_variant_get(v, "$", "boolean"), 3
    else:
        return F.lit(False)
    from docengine.functions.filters import RANGES

    held = left == right if op == "$eq" else getattr(left, RANGES[op])(right)
    return sure((rank(v) == want) & held)


def mixed_fields(df: DataFrame) -> list[str]:
    """Top-level fields that hold values of more than one type, so that a typed reading would lose them."""
    text = df.select(F.schema_of_variant_agg(F.col("doc"))).first()[0] or "OBJECT<>"
    inner = text[len("OBJECT<") : -1] if text.startswith("OBJECT<") else ""
    depth, start, parts = 0, 0, []
    for i, ch in enumerate(inner):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(inner[start:i])
            start = i + 1
    parts.append(inner[start:])
    return [p.split(":")[0].strip().strip("`") for p in parts if p.partition(":")[2].strip() == "VARIANT"]
