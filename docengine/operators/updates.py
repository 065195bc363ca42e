"""The update language: a document of operators becomes new column values, computed only where a condition holds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.errors import BadFilterError
from docengine.functions import paths, values, variant
from docengine.functions.filters import all_of, sure

# Update operators, and the conditions that $pull takes.
OPERATORS = {"$set", "$setOnInsert", "$unset", "$inc", "$mul", "$min", "$max", "$rename", "$push", "$addToSet", "$pop", "$pull", "$pullAll", "$currentDate"}
PULL = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in"}


def is_operators(update: dict) -> bool:
    keys = [k.startswith("$") for k in update]
    if any(keys) and not all(keys):
        raise BadFilterError("an update is operators or a document, not both")
    return any(keys)


def _error(message: str, code: int) -> BadFilterError:
    error = BadFilterError(message)
    error.code = code
    return error


@dataclass
class Draft:
    """Columns as the operators applied so far leave them."""

    schema: T.StructType
    changed: dict[str, Column] = field(default_factory=dict)
    kinds: dict[str, T.DataType] = field(default_factory=dict)

    def kind(self, name: str) -> T.DataType | None:
        found = paths.field_of(self.schema, name)
        return self.kinds.get(name) or (found.dataType if found else None)

    def now(self, name: str) -> Column:
        if name in self.changed:
            return self.changed[name]
        return paths.column(name) if paths.field_of(self.schema, name) else F.lit(None)

    def read(self, path: str) -> tuple[Column, T.DataType | None]:
        head, *rest = path.split(".")
        at, kind = self.now(head), self.kind(head)
        for part in rest:
            if isinstance(kind, T.StructType) and paths.field_of(kind, part):
                at, kind = at[part], kind[part].dataType
            elif isinstance(kind, T.ArrayType) and part.isdigit():
                at, kind = F.get(at, F.lit(int(part))), kind.elementType
            else:
                return F.lit(None), None
        return at, kind

    def write(self, path: str, value: Column, kind: T.DataType) -> None:
        head, *rest = path.split(".")
        if head == "_id":
            raise _error("_id does not change", 66)
        old = self.kind(head)
        if not rest:
            self.changed[head] = value if old is None or same(old, kind) else value.cast(merged(old, kind))
            self.kinds[head] = kind if old is None or same(old, kind) else merged(old, kind)
            return
        made, made_kind = _nested(self.now(head) if old is not None else None, old, rest, value, kind)
        self.changed[head], self.kinds[head] = made, made_kind

    def remove(self, path: str) -> None:
        head, *rest = path.split(".")
        kind = self.kind(head)
        if head == "_id":
            raise _error("_id does not change", 66)
        if kind is None:
            return
        if not rest:
            self.changed[head], self.kinds[head] = F.lit(None).cast(kind), kind
            return
        at, leaf_kind = self.read(path)
        if leaf_kind is not None and not _through_array(kind, rest):
            self.changed[head], self.kinds[head] = _nested(self.now(head), kind, rest, F.lit(None).cast(leaf_kind), leaf_kind)


def same(a: T.DataType, b: T.DataType) -> bool:
    return a.simpleString() == b.simpleString()


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both; different families need a variant collection."""
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType) or paths.family(a) in ("array", "object") and paths.family(a) == paths.family(b):
        return a
    if paths.family(a) == paths.family(b) == "number":
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return T.LongType() if isinstance(a, whole) and isinstance(b, whole) else T.DoubleType()
    if paths.family(a) == paths.family(b):
        return a
    raise BadFilterError(f"a {b.simpleString()} does not fit a {a.simpleString()} field; use a variant collection")


def _through_array(kind: T.DataType, rest: list[str]) -> bool:
    for part in rest:
        if isinstance(kind, T.ArrayType):
            return True
        found = paths.field_of(kind, part) if isinstance(kind, T.StructType) else None
        if found is None:
            return False
        kind = found.dataType
    return False


def _nested(at: Column | None, kind: T.DataType | None, rest: list[str], value: Column, value_kind: T.DataType) -> tuple[Column, T.DataType]:
    """``at`` with ``rest`` set to ``value``; missing objects on the way are made."""
    if isinstance(kind, T.ArrayType):
        raise _error("an array is in the way of the path", 28)
    if kind is not None and not isinstance(kind, (T.StructType, T.NullType)):
        raise _error("a plain value is in the way of the path", 28)
    fields = list(kind.fields) if isinstance(kind, T.StructType) else []
    name, deeper = rest[0], rest[1:]
    old = next((f for f in fields if f.name == name), None)
    inner = at[name] if at is not None and old is not None else None
    if deeper:
        made, made_kind = _nested(inner, old.dataType if old else None, deeper, value, value_kind)
    else:
        made_kind = value_kind if old is None or same(old.dataType, value_kind) else merged(old.dataType, value_kind)
        made = value.cast(made_kind)
    kept = [(f.name, at[f.name], f.dataType) for f in fields]
    parts = [(n, made if n == name else c, made_kind if n == name else k) for n, c, k in kept]
    if old is None:
        parts.append((name, made, made_kind))
    return F.struct(*(c.alias(n) for n, c, _ in parts)), T.StructType([T.StructField(n, k) for n, _, k in parts])


def draft(update: dict, schema: T.StructType, inserting: bool = False) -> Draft:
    """New values of the columns that ``update`` changes."""
    d = Draft(schema)
    for op, fields in update.items():
        if op not in OPERATORS:
            raise BadFilterError(f"unknown update operator {op}")
        if not isinstance(fields, dict):
            raise BadFilterError(f"{op} needs a document")
        if op == "$setOnInsert" and not inserting:
            continue
        for path, arg in fields.items():
            _apply(d, "$set" if op == "$setOnInsert" else op, path, arg)
    return d


def _number(arg: Any, op: str) -> int | float:
    arg = values.plain(arg)
    if isinstance(arg, bool) or not isinstance(arg, (int, float)):
        raise _error(f"{op} needs a number", 14)
    return arg


def _apply(d: Draft, op: str, path: str, arg: Any) -> None:
    at, kind = d.read(path)
    if op == "$set":
        plain = values.plain(arg)
        if plain is None and kind is not None:
            d.write(path, F.lit(None).cast(kind), kind)
        else:
            want = values.type_of(plain)
            want = kind if kind is not None and paths.family(kind) == paths.family(want) in ("array", "object", "time") else want
            d.write(path, values.literal(plain, want), want)
    elif op == "$unset":
        d.remove(path)
    elif op in ("$inc", "$mul"):
        by = _number(arg, op)
        if kind is not None and paths.family(kind) not in ("number", "null"):
            raise _error(f"{op} needs a numeric field", 14)
        want = values.type_of(by) if kind is None else merged(kind, values.type_of(by))
        zero = F.coalesce(at.cast(want), F.lit(0).cast(want))
        d.write(path, (zero + F.lit(by) if op == "$inc" else zero * F.lit(by)).cast(want), want)
    elif op in ("$min", "$max"):
        plain = values.plain(arg)
        right_kind = values.type_of(plain)
        if kind is not None and paths.family(kind) != paths.family(right_kind):
            d.write(path, F.coalesce(at, F.lit(None).cast(kind)), kind)
            return
        want = merged(kind, right_kind) if kind is not None else right_kind
        pick = F.least if op == "$min" else F.greatest
        d.write(path, pick(at.cast(want), values.literal(plain, want)) if kind is not None else values.literal(plain, want), want)
    elif op == "$rename":
        if kind is None:
            return
        target, target_kind = d.read(arg)
        moved = F.when(at.isNotNull(), at).otherwise(target.cast(kind)) if target_kind is not None else at
        d.remove(path)
        d.write(arg, moved, kind)
    elif op == "$currentDate":
        stamp = isinstance(arg, dict) and arg.get("$type") == "timestamp"
        if arg is not True and not stamp and not (isinstance(arg, dict) and arg.get("$type") == "date"):
            raise BadFilterError("$currentDate needs true or a $type")
        d.write(path, F.current_timestamp().cast("timestamp_ntz"), T.TimestampNTZType())
    else:
        _array(d, op, path, arg, at, kind)


def _array(d: Draft, op: str, path: str, arg: Any, at: Column, kind: T.DataType | None) -> None:
    if kind is not None and not isinstance(kind, (T.ArrayType, T.NullType)):
        raise _error(f"{op} needs an array field", 2)
    if op == "$pop":
        if arg not in (1, -1):
            raise _error("$pop needs 1 or -1", 9)
        if kind is None:
            return
        n = F.size(at)
        tail = F.slice(at, 1, n - 1) if arg == 1 else F.slice(at, 2, n)
        d.write(path, F.when(at.isNull() | (n == 0), at).otherwise(tail), kind)
        return
    listed = arg["$each"] if isinstance(arg, dict) and "$each" in arg else None
    if op in ("$push", "$addToSet"):
        allowed = {"$each", "$position", "$slice"} if op == "$push" else {"$each"}
        if isinstance(arg, dict) and any(k.startswith("$") for k in arg) and (listed is None or set(arg) - allowed):
            raise BadFilterError(f"unknown modifier of {op}")
        items = listed if listed is not None else [arg]
        if not isinstance(items, list):
            raise BadFilterError("$each needs a list")
    elif op == "$pullAll":
        if not isinstance(arg, list):
            raise BadFilterError("$pullAll needs a list")
        items = arg
    else:
        items = [] if _is_condition(arg) else [arg]
    own = values.type_of([values.plain(v) for v in items])
    inner = kind.elementType if isinstance(kind, T.ArrayType) else own.elementType
    if isinstance(kind, T.ArrayType) and op in ("$push", "$addToSet") and items:
        inner = merged(kind.elementType, own.elementType)
    want = T.ArrayType(inner)
    held = F.coalesce(at.cast(want), F.array().cast(want))
    if op == "$push":
        made = F.array(*(values.literal(v, inner) for v in items)).cast(want)
        n = F.size(held)
        place = arg.get("$position") if listed is not None else None
        if place is None:
            out = F.concat(held, made)
        else:
            cut = F.least(n, F.lit(place)) if place >= 0 else F.greatest(n + place, F.lit(0))
            out = F.concat(F.slice(held, F.lit(1), cut), made, F.slice(held, cut + 1, n))
        keep = arg.get("$slice") if listed is not None else None
        if keep:
            out = F.slice(out, 1, keep) if keep > 0 else F.slice(out, F.greatest(F.size(out) + keep + 1, F.lit(1)), F.lit(-keep))
        d.write(path, out, want)
    elif op == "$addToSet":
        made = held
        for v in items:
            one = values.literal(v, inner)
            made = F.when(F.exists(made, _equals(one)), made).otherwise(F.array_append(made, one))
        d.write(path, made, want)
    else:
        if op == "$pull" and _is_condition(arg):
            gone = lambda x: sure(all_of([_pulled(o, v, x, inner) for o, v in arg.items()]))
        else:
            fit = [values.literal(v, inner) for v in items if values.plain(v) is None or values.family(values.plain(v)) == paths.family(inner)]
            gone = lambda x: reduce(lambda a, b: a | b, [x.eqNullSafe(v) for v in fit], F.lit(False))
        d.write(path, F.filter(held, lambda x: ~gone(x)), want)


def _equals(one: Column):
    return lambda x: x.eqNullSafe(one)


def _is_condition(arg: Any) -> bool:
    return isinstance(arg, dict) and bool(arg) and all(k.startswith("$") for k in arg) and not values.is_wrapper(arg)


def _pulled(op: str, value: Any, x: Column, kind: T.DataType) -> Column:
    """A condition of $pull on one element; ranges are of numbers only, an unknown operator takes nothing."""
    from docengine.functions.filters import RANGES, leaf

    if op not in PULL:
        return F.lit(False)
    if op in RANGES and (paths.family(kind) != "number" or values.family(values.plain(value)) != "number"):
        return F.lit(False)
    return leaf(op, value, x, kind, {})


def updated(df: DataFrame, update: dict, condition: Column | None = None, inserting: bool = False) -> DataFrame:
    """``df`` with the update applied where ``condition`` holds (everywhere without one). A document without operators
    replaces all columns but ``_id``."""
    if variant.is_variant(df.schema):
        raise variant.unsupported("an update")
    here = sure(condition) if condition is not None else None
    if not is_operators(update):
        if "_id" in update and "_id" not in df.columns:
            raise _error("_id does not change", 66)
        plain = {k: v for k, v in update.items() if k != "_id"}
        d = Draft(df.schema)
        for name in df.columns:
            if name != "_id" and name not in plain:
                d.remove(name)
        for name, value in plain.items():
            _apply(d, "$set", name, value)
    else:
        d = draft(update, df.schema, inserting)
    out = {}
    for name, value in d.changed.items():
        kind = d.kinds[name]
        old = paths.field_of(df.schema, name)
        before = fitted(paths.column(name), old.dataType, kind) if old is not None else F.lit(None).cast(kind)
        out[name] = value.cast(kind) if here is None else F.when(here, value.cast(kind)).otherwise(before)
    return df.withColumns(out) if out else df


def fitted(at: Column, have: T.DataType, want: T.DataType) -> Column:
    """``at`` as type ``want``, which has all that ``have`` has; new struct fields are null."""
    if same(have, want):
        return at
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        parts = []
        for f in want.fields:
            own = paths.field_of(have, f.name)
            parts.append((fitted(at[f.name], own.dataType, f.dataType) if own else F.lit(None).cast(f.dataType)).alias(f.name))
        return F.when(at.isNotNull(), F.struct(*parts))
    return at.cast(want)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``_id`` of the rows that an update left different."""
    names = [c for c in new.columns if c != "_id"]
    left = new.select("_id", *(paths.column(c).alias(f"n{i}") for i, c in enumerate(names)))
    right = old.select("_id", *((fitted(paths.column(c), old.schema[c].dataType, new.schema[c].dataType) if c in old.columns else F.lit(None).cast(new.schema[c].dataType)).alias(f"o{i}") for i, c in enumerate(names)))
    differs = reduce(lambda a, b: a | b, (~F.col(f"n{i}").eqNullSafe(F.col(f"o{i}")) for i in range(len(names))), F.lit(False))
    return left.join(right, "_id").where(differs).select("_id")


def seed(filter_: dict | None) -> dict:
    """The document that an upsert starts from: the filter's equalities."""
    out: dict[str, Any] = {}
    for key, value in (filter_ or {}).items():
        if key == "$and":
            for part in value:
                out |= seed(part)
        elif key.startswith("$"):
            continue
        elif isinstance(value, dict) and any(k.startswith("$") for k in value):
            if "$eq" in value:
                out[key] = values.plain(value["$eq"])
            elif values.is_wrapper(value):
                out[key] = values.plain(value)
        else:
            out[key] = values.plain(value)
    return out


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)
