"""Pipelines lowered to DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.errors import NotFoundError
from docengine.functions import paths, values, variant
from docengine.functions.filters import compile_filter
from docengine.operators.find import project, sortable
from docengine.plans.lineage import cut
from docengine.plans.stages import IN_ORDER, Stage, parse, rewrite

#: Hidden column with the place of a row in the order of the last sort, where a later stage may lose that order.
ORDER = "__order"
#: Stages that shuffle rows or make several of one.
LOSES_ORDER = {"$lookup", "$join", "$unwind"}

Catalog = Mapping[str, DataFrame] | Callable[[str], DataFrame]


def aggregate(df: DataFrame, pipeline: list[dict], catalog: Catalog | None = None, *, optimise: bool = True) -> DataFrame:
    """The result of ``pipeline`` on ``df``; ``catalog`` gives the tables that $lookup names."""
    stages = parse(pipeline)
    return Lowering(catalog).run(df, rewrite(stages) if optimise else stages)


def expression(spec: Any, schema: T.StructType) -> tuple[Column, T.DataType]:
    """``"$path"`` (strict), ``{$literal: x}`` or a constant."""
    if isinstance(spec, str) and spec.startswith("$"):
        kind = paths.strict_type(schema, spec[1:])
        return (paths.strict(schema, spec[1:]), kind) if kind is not None else (F.lit(None).cast("string"), T.StringType())
    value = spec["$literal"] if isinstance(spec, dict) and set(spec) == {"$literal"} else spec
    return values.literal(value), values.type_of(value)


class Lowering:
    def __init__(self, catalog: Catalog | None = None):
        self.catalog = catalog
        #: Whether rows are in the order of ORDER, or of a sort that no stage has disturbed.
        self.in_order = False
        self.sorted = False

    def table(self, name: str) -> DataFrame:
        found = self.catalog(name) if callable(self.catalog) else (self.catalog or {}).get(name)
        if found is None:
            raise NotFoundError(f"no collection {name}")
        return found

    def run(self, df: DataFrame, stages: list[Stage]) -> DataFrame:
        if "_id" in df.columns and any(s.op in ("$skip", "$limit") for s in _until_resorted(stages)) and _loses_order(stages):
            df = df.withColumn(ORDER, order_key(df, []))
        for i, stage in enumerate(stages):
            df = getattr(self, "do_" + stage.op[1:])(df, stage.arg, stages[i + 1 :])
            if stage.op in LOSES_ORDER:
                self.in_order = False
        if ORDER in df.columns and self.sorted and not self.in_order:
            df = df.orderBy(ORDER)
        return df.drop(ORDER)

    # Stages. Each takes the rows so far, its argument and the stages after it.

    def do_match(self, df: DataFrame, arg: dict, after: list[Stage]) -> DataFrame:
        return df.where(compile_filter(arg, df.schema))

    def do_sort(self, df: DataFrame, arg: list[tuple[str, int]], after: list[Stage]) -> DataFrame:
        """Rows are sorted here if no stage disturbs them until they are looked at; else they only get their place."""
        self.sorted = True
        if variant.is_variant(df.schema):
            if any(s.op == "$group" and _takes_in_order(s.arg) for s in after):
                raise variant.unsupported("$first or $last after $sort")
            self.in_order = True
            return df.orderBy(*variant.sorted_by(df, arg))
        later = _loses_order(after)
        if later or any(s.op == "$group" for s in after):
            df = df.drop(ORDER).withColumn(ORDER, order_key(df, arg))
        else:
            df = df.drop(ORDER)
        self.in_order = not later
        return df if later else df.orderBy(*sort_columns(df, arg))

    def _paged(self, df: DataFrame) -> DataFrame:
        """Rows in a known order: that of the last sort, else of ``_id``."""
        if self.in_order:
            return df
        self.in_order = True
        self.sorted = True
        if ORDER in df.columns:
            return df.orderBy(ORDER)
        return df.orderBy("_id") if "_id" in df.columns else df

    def do_skip(self, df: DataFrame, arg: int, after: list[Stage]) -> DataFrame:
        if not arg:
            return df
        out = self._paged(df).offset(arg)
        # Once a shuffled offset has run, adaptive execution may take its rows for none and leave out a limit above.
        return cut(out, "skip") if _loses_order(after) and any(s.op in ("$skip", "$limit") for s in after) else out

    def do_limit(self, df: DataFrame, arg: int, after: list[Stage]) -> DataFrame:
        return self._paged(df).limit(arg)

    def do_count(self, df: DataFrame, arg: str, after: list[Stage]) -> DataFrame:
        self.sorted = self.in_order = False
        return df.agg(F.count(F.lit(1)).alias(arg))

    def do_project(self, df: DataFrame, arg: dict, after: list[Stage]) -> DataFrame:
        out = project(df.drop(ORDER), arg)
        return _with_order(df, out) if ORDER in df.columns else out

    def do_unwind(self, df: DataFrame, arg: dict, after: list[Stage]) -> DataFrame:
        if variant.is_variant(df.schema):
            raise variant.unsupported("$unwind")
        found = paths.resolve(df.schema, arg["path"], "strict")
        if found is None:
            return df if arg["preserve"] else df.limit(0)
        if not isinstance(found.kind, T.ArrayType):
            return df if arg["preserve"] else df.where(found.column.isNotNull())
        head, _, rest = arg["path"].partition(".")
        placed = ORDER in df.columns
        make = (F.posexplode_outer if placed else F.explode_outer) if arg["preserve"] else F.posexplode if placed else F.explode
        out = df.select("*", make(found.column).alias(*(["__at"] if placed else []), "__one"))
        out = out.withColumn(head, paths.column(head).withField(rest, F.col("__one")) if rest else F.col("__one"))
        return _placed_within(out, F.col("__at")).drop("__at", "__one") if placed else out.drop("__one")

    def _foreign(self, df: DataFrame, arg: dict) -> tuple[DataFrame, Column] | None:
        """Foreign documents by key (__key, __doc), and the local key; None where nothing can be equal."""
        other = self.table(arg["from"])
        if variant.is_variant(df.schema) or variant.is_variant(other.schema):
            raise variant.unsupported("$lookup")
        local_type = paths.strict_type(df.schema, arg["localField"])
        found = paths.resolve(other.schema, arg["foreignField"])
        doc = F.struct(*(paths.column(c) for c in other.columns)).alias("__doc")
        if found is None or local_type is None:
            return None
        many = found.many or isinstance(found.kind, T.ArrayType)
        kind = found.kind.elementType if isinstance(found.kind, T.ArrayType) else found.kind
        if paths.family(kind) != paths.family(local_type):
            return None
        at = F.flatten(found.column) if found.many and isinstance(found.kind, T.ArrayType) else found.column
        key = F.explode(F.array_distinct(at)) if many else at
        return other.select(key.alias("__key"), doc).where("__key is not null"), paths.strict(df.schema, arg["localField"])

    def do_lookup(self, df: DataFrame, arg: dict, after: list[Stage]) -> DataFrame:
        found = self._foreign(df, arg)
        other = self.table(arg["from"])
        kind = T.ArrayType(T.StructType(other.schema.fields))
        if found is None:
            return df.withColumn(arg["as"], F.array().cast(kind))
        foreign, local = found
        local_df = df.withColumn("__local", local)
        # Only documents that some row looks up are collected.
        wanted = local_df.select(F.col("__local").alias("__key")).where("__key is not null")
        grouped = foreign.join(wanted, "__key", "left_semi").groupBy("__key").agg(F.collect_list("__doc").alias("__docs"))
        if "_id" in other.columns:
            places = F.array_sort(F.transform("__docs", lambda d, i: F.struct(d["_id"].alias("id"), i.alias("i"))))
            grouped = grouped.select("__key", F.transform(places, lambda x: F.col("__docs")[x["i"]]).alias("__docs"))
        joined = local_df.join(grouped, F.col("__local") == F.col("__key"), "left")
        return joined.withColumn(arg["as"], F.coalesce("__docs", F.array().cast(kind))).drop("__local", "__key", "__docs")

    def do_join(self, df: DataFrame, arg: dict, after: list[Stage]) -> DataFrame:
        """$lookup with the $unwind of its array: a plain join, nothing collected."""
        found = self._foreign(df, arg)
        how = "left" if arg["preserve"] else "inner"
        if found is None:
            kind = T.StructType(self.table(arg["from"]).schema.fields)
            out = df.withColumn(arg["as"], F.lit(None).cast(kind))
            return out if arg["preserve"] else out.limit(0)
        foreign, local = found
        joined = df.withColumn("__local", local).join(foreign, F.col("__local") == F.col("__key"), how)
        if ORDER in df.columns and "_id" in self.table(arg["from"]).columns:
            joined = _placed_within(joined, F.col("__doc._id"))
        return joined.withColumn(arg["as"], F.col("__doc")).drop("__local", "__key", "__doc")

    def do_group(self, df: DataFrame, arg: dict, after: list[Stage]) -> DataFrame:
        if variant.is_variant(df.schema):
            self.sorted = self.in_order = False
            return variant.grouped(df, arg)
        key = group_key(arg["_id"], df.schema)
        order = F.col(ORDER) if ORDER in df.columns else F.col("_id") if "_id" in df.columns else F.lit(0)
        made = [accumulator(spec, df.schema, order).alias(name) for name, spec in arg.items() if name != "_id"]
        self.sorted = self.in_order = False
        grouped = df.groupBy(key.alias("_id"))
        return grouped.agg(*made) if made else df.select(key.alias("_id")).distinct()


def _with_order(df: DataFrame, projected: DataFrame) -> DataFrame:
    return df.select(*(paths.column(c) for c in projected.columns), F.col(ORDER))


def _placed_within(df: DataFrame, at: Column) -> DataFrame:
    """Rows made of one row keep its place, and among them come in the order of ``at``."""
    return df.withColumn(ORDER, F.struct(F.col(ORDER).alias("k0"), at.alias("k1")))


def _until_resorted(stages: list[Stage]) -> list[Stage]:
    """The stages that see rows in the order they come in."""
    out = []
    for s in stages:
        if s.op in ("$sort", "$group", "$count"):
            break
        out.append(s)
    return out


def _takes_in_order(spec: dict) -> bool:
    return any(next(iter(v)) in IN_ORDER for k, v in spec.items() if k != "_id")


def _loses_order(after: list[Stage]) -> bool:
    return any(s.op in LOSES_ORDER for s in _until_resorted(after))


def sort_columns(df: DataFrame, keys: list[tuple[str, int]]) -> list[Column]:
    """Order of $sort: strict paths, missing last either way, ties by ``_id``."""
    out = []
    for path, way in keys:
        if sortable(paths.strict_type(df.schema, path)):
            c = paths.strict(df.schema, path)
            out.append(c.asc_nulls_last() if way == 1 else c.desc_nulls_last())
    return [*out, F.col("_id").asc()] if "_id" in df.columns else out


def order_key(df: DataFrame, keys: list[tuple[str, int]]) -> Column:
    """A struct whose ascending order is that of ``sort_columns``, for accumulators that take rows in order."""
    parts = []
    for path, way in keys:
        kind = paths.strict_type(df.schema, path)
        if not sortable(kind):
            continue
        c = paths.strict(df.schema, path)
        if way == -1:
            what = paths.family(kind)
            if what == "number":
                c = -c.cast("double") if isinstance(kind, (T.FloatType, T.DoubleType)) else -c.cast("decimal(38,6)")
            elif what == "time":
                c = -F.unix_micros(c.cast("timestamp"))
            else:
                # Digits of the bytes turned round; a longer string goes before its own beginning.
                c = F.concat(F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
        parts += [c.isNull(), c]
    parts += [F.col("_id")] if "_id" in df.columns else []
    return F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))) if parts else F.struct(F.lit(0).alias("k0"))


def group_key(spec: Any, schema: T.StructType) -> Column:
    if isinstance(spec, dict) and not (set(spec) == {"$literal"}):
        return F.struct(*(expression(v, schema)[0].alias(k) for k, v in spec.items())) if spec else F.lit(None).cast("string")
    made, kind = expression(spec, schema)
    return made.cast("string") if isinstance(kind, T.NullType) else made


def accumulator(spec: dict, schema: T.StructType, order: Column) -> Column:
    ((op, arg),) = spec.items()
    if op == "$count":
        return F.count(F.lit(1))
    e, kind = expression(arg, schema)
    number = paths.family(kind) == "number"
    if op == "$sum":
        return F.coalesce(F.sum(e.cast("double")), F.lit(0.0)) if number else F.coalesce(F.sum(F.lit(0.0)), F.lit(0.0))
    if op == "$avg":
        return F.avg(e.cast("double")) if number else F.avg(F.lit(None).cast("double"))
    if op in ("$min", "$max"):
        if not sortable(kind):
            return F.first(e, ignorenulls=True)
        return F.min(e) if op == "$min" else F.max(e)
    if op in ("$first", "$last"):
        return (F.min_by if op == "$first" else F.max_by)(e, order)
    if op == "$push":
        listed = F.array_sort(F.collect_list(F.when(e.isNotNull(), F.struct(order.alias("o"), e.alias("e")))))
        return F.transform(listed, lambda x: x["e"])
    return F.array_sort(F.collect_set(e))
