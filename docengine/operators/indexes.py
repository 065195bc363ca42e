"""Indexes as metadata: uniqueness, and a layout whose Parquet statistics let a scan skip what a filter rules out."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.errors import BadFilterError, DuplicateKeyError
from docengine.functions import paths


@dataclass(frozen=True)
class Index:
    fields: tuple[str, ...]
    unique: bool = False

    @property
    def name(self) -> str:
        return "_".join(f"{f}_1" for f in self.fields)

    def to_json(self) -> dict:
        return {**asdict(self), "fields": list(self.fields), "name": self.name}


def command_index(key: dict, unique: bool = False) -> Index:
    """As commands give it: fields alphabetically, directions without effect."""
    return Index(tuple(sorted(key)), unique)


def add(indexes: list[Index], new: Index) -> list[Index]:
    if not new.fields or not all(isinstance(f, str) and f for f in new.fields):
        raise BadFilterError("an index has fields")
    for old in indexes:
        if old.fields == new.fields:
            if old.unique != new.unique:
                raise BadFilterError("an index of these fields differs in uniqueness")
            return indexes
    return [*indexes, new]


def _key(df: DataFrame, index: Index) -> DataFrame:
    """Index keys of each row: an array gives one for each element; null, missing and an empty array are one key."""
    out = df
    for i, f in enumerate(index.fields):
        found = paths.resolve(df.schema, f)
        name = f"__k{i}"
        if found is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
        elif found.many or isinstance(found.kind, T.ArrayType):
            at = F.flatten(found.column) if found.many and isinstance(found.kind, T.ArrayType) else found.column
            out = out.withColumn(name, F.explode_outer(F.array_distinct(at)))
        else:
            out = out.withColumn(name, found.column)
    return out.select("_id", *(F.col(f"__k{i}") for i in range(len(index.fields))))


def conflicts(df: DataFrame, index: Index) -> DataFrame:
    """Keys that more than one document has."""
    names = [f"__k{i}" for i in range(len(index.fields))]
    per = _key(df, index).groupBy(*names).agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.count(F.lit(1)).alias("n"))
    return per.where("n > 1")


def check_unique(df: DataFrame, indexes: list[Index]) -> None:
    for index in indexes:
        if index.unique:
            row = conflicts(df, index).first()
            if row is not None:
                raise DuplicateKeyError(f"index {index.name}: {row['first']} and {row['last']} share a key")


def check_new(new: DataFrame, old: DataFrame | None, indexes: list[Index]) -> None:
    """check_unique for rows that join others which are known to be in order: only their keys are looked up."""
    check_unique(new, indexes)
    for index in indexes if old is not None else []:
        if index.unique:
            names = [f"__k{i}" for i in range(len(index.fields))]
            mine = _key(new, index).select(F.col("_id").alias("__new"), *(F.col(n).alias(f"{n}n") for n in names))
            same = [F.col(n).eqNullSafe(F.col(f"{n}n")) for n in names]
            row = _key(old, index).join(mine, reduce(lambda a, b: a & b, same)).where("_id <> __new").first()
            if row is not None:
                raise DuplicateKeyError(f"index {index.name}: {row['_id']} and {row['__new']} share a key")


def layout(df: DataFrame, indexes: list[Index], partitions: int | None = None) -> DataFrame:
    """Rows ranged and sorted by the first index's sortable fields, so that row groups have narrow minima and maxima."""
    for index in indexes:
        columns: list[Column] = []
        for f in index.fields:
            found = paths.resolve(df.schema, f, "strict")
            if found is not None and paths.family(found.kind) in ("number", "string", "time", "bool"):
                columns.append(found.column)
        if columns:
            ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
            return ranged.sortWithinPartitions(*columns)
    return df
