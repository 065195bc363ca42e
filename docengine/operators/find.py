"""find, count, distinct and explain over a collection's DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.errors import BadFilterError
from docengine.functions import paths, variant
from docengine.functions.filters import compile_filter

SortSpec = dict[str, int] | list[tuple[str, int]] | None


def sort_keys(spec: SortSpec) -> list[tuple[str, int]]:
    """Keys in order: those of a dict alphabetically, a list as it is."""
    if not spec:
        return []
    keys = sorted(spec.items()) if isinstance(spec, dict) else [tuple(k) for k in spec]
    for name, way in keys:
        if way not in (1, -1) or isinstance(way, bool):
            raise BadFilterError(f"sort order of {name} is 1 or -1")
    return keys


def sortable(kind: T.DataType | None) -> bool:
    return kind is not None and paths.family(kind) in ("number", "string", "time")


def ordered(df: DataFrame, spec: SortSpec) -> list[Column]:
    """Order of ``find``: top-level keys, null and missing lowest, ties by ``_id``; other types than numbers, strings and
    times tie."""
    out = []
    for name, way in sort_keys(spec):
        if variant.is_variant(df.schema) and name != "_id":
            c = variant.key(name)
            out.append(c.asc() if way == 1 else c.desc())
            continue
        found = paths.field_of(df.schema, name)
        if found is not None and sortable(found.dataType):
            c = paths.column(name)
            out.append(c.asc_nulls_first() if way == 1 else c.desc_nulls_last())
    return [*out, F.col("_id").asc()] if "_id" in df.columns else out


def project(df: DataFrame, spec: dict[str, Any] | list[str] | None) -> DataFrame:
    """A list keeps ``_id`` and the listed fields; a dict of 1 and 0 includes or excludes top-level fields."""
    if not spec:
        return df
    if variant.is_variant(df.schema):
        return variant.project(df, spec)
    if isinstance(spec, (list, tuple)):
        return df.select(*(paths.column(n) for n in dict.fromkeys(["_id", *spec]) if n in df.columns))
    include, exclude, keep_id = [], [], True
    for name, value in spec.items():
        if "." in name:
            raise BadFilterError("projection takes top-level fields")
        if value not in (0, 1, True, False):
            raise BadFilterError("projection values are 0 or 1")
        if name == "_id":
            keep_id = bool(value)
        else:
            (include if value else exclude).append(name)
    if include and exclude:
        error = BadFilterError("projection mixes inclusion and exclusion")
        error.code = 31254
        raise error
    if include or (not exclude and keep_id and "_id" in spec):
        names = (["_id"] if keep_id else []) + include
        return df.select(*(paths.column(n) for n in dict.fromkeys(names) if n in df.columns))
    gone = exclude + ([] if keep_id else ["_id"])
    return df.select(*(paths.column(n) for n in df.columns if n not in gone))


def find(df: DataFrame, filter_: dict | None = None, *, sort: SortSpec = None, skip: int = 0, limit: int = 0, projection: Any = None) -> DataFrame:
    """Rows that pass, in order when a sort or a page is asked for; a limit of 0 is none, a negative one its size."""
    if skip < 0:
        raise BadFilterError("skip is not negative")
    out = df.where(compile_filter(filter_, df.schema)) if filter_ else df
    if sort or skip or limit:
        out = out.orderBy(*ordered(out, sort))
    if skip:
        out = out.offset(skip)
    if limit:
        out = out.limit(abs(limit))
    return project(out, projection)


def get(df: DataFrame, id_: str) -> DataFrame:
    return df.where(F.col("_id") == F.lit(id_)).limit(1)


def count(df: DataFrame, filter_: dict | None = None) -> int:
    return (df.where(compile_filter(filter_, df.schema)) if filter_ else df).count()


def counted(df: DataFrame, filter_: dict | None = None, name: str = "n") -> DataFrame:
    """The count as a table of one row."""
    return (df.where(compile_filter(filter_, df.schema)) if filter_ else df).agg(F.count(F.lit(1)).alias(name))


def distinct(df: DataFrame, key: str, filter_: dict | None = None) -> DataFrame:
    """Distinct values at ``key``, a strict path; an array is unrolled one level. Nulls are left out, as missing ones are."""
    kept = df.where(compile_filter(filter_, df.schema)) if filter_ else df
    if variant.is_variant(df.schema) and key != "_id":
        return variant.distinct(kept, key)
    found = paths.resolve(df.schema, key, "strict")
    if found is None:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("value", T.StringType())]))
    value = F.explode(found.column) if isinstance(found.kind, T.ArrayType) else found.column
    return kept.select(value.alias("value")).where("value is not null").distinct()


@dataclass
class ExplainResult:
    """How a find would run."""

    plan: str
    index: list[str] = field(default_factory=list)
    covered: list[str] = field(default_factory=list)
    pushed: list[str] = field(default_factory=list)
    exact: bool = False
    re_match: bool = True
    physical: str = ""


def explain(df: DataFrame, filter_: dict | None = None, indexes: Iterable[Iterable[str]] = ()) -> ExplainResult:
    """IXSCAN when an index's leading field has a condition, else COLLSCAN; pushed filters as in the physical plan."""
    used = _bounding(filter_)
    text = find(df, filter_)._jdf.queryExecution().executedPlan().toString()
    pushed = [p.strip() for part in text.split("PushedFilters: [")[1:] for p in part.split("]")[0].split(", ") if p.strip()]
    best: list[str] = []
    for fields in indexes:
        prefix = []
        for f in fields:
            if f not in used:
                break
            prefix.append(f)
        if len(prefix) > len(best):
            best, index = prefix, list(fields)
    if not best:
        return ExplainResult("COLLSCAN", pushed=pushed, physical=text)
    top = {k: v for k, v in (filter_ or {}).items() if not k.startswith("$")}
    exact = set(top) == set(filter_ or {}) == set(best) and all(not isinstance(v, dict) or set(v) <= {"$eq", "$in"} for v in top.values())
    return ExplainResult("IXSCAN", index, best, pushed, exact, not exact, text)


def _bounding(filter_: dict | None) -> set[str]:
    """Fields whose conditions every match meets: those at the top and under $and, not under $or, $nor or $not."""
    out: set[str] = set()
    for name, arg in (filter_ or {}).items():
        if name == "$and":
            out |= set().union(*(_bounding(part) for part in arg))
        elif not name.startswith("$"):
            out.add(name)
    return out


#: A page of a cursor ends behind the row that brings it to so many characters.
REPLY_CHARS = 16 << 20


class Cursor:
    """Pages of a result through the driver; at most a page is held at once."""

    def __init__(self, df: DataFrame, batch: int = 101):
        self._rows, self._batch, self.done = df.toLocalIterator(), batch, False

    def next_batch(self, size: int | None = None) -> list:
        out, held = [], 0
        while len(out) < (size or self._batch) and held < REPLY_CHARS:
            row = next(self._rows, None)
            if row is None:
                self.done = True
                break
            out.append(row)
            held += len(repr(row))
        return out

    def kill(self) -> None:
        self._rows, self.done = iter(()), True


def page(df: DataFrame, filter_: dict | None = None, *, skip: int = 0, limit: int = 25, most: int = 200) -> tuple[DataFrame, int]:
    """One page in order of ``_id`` and the total."""
    return find(df, filter_, skip=skip, limit=min(max(limit, 1), most)), count(df, filter_)
