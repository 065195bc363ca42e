"""Repair: drop rows that break a collection's rules and count them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docengine.operators.indexes import Index, _key

MAX_BYTES = 1 << 20


@dataclass
class Report:
    scanned: int = 0
    bad_ids: int = 0
    oversize: int = 0
    duplicates: int = 0
    unique_conflicts: int = 0
    kept: int = 0


def size_of(df: DataFrame):
    return F.octet_length(F.to_json(F.struct("*")))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("__row", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__row = 1").drop("__row")


def repaired(df: DataFrame, unique: list[Index] = ()) -> DataFrame:
    """Rows with a non-empty string ``_id`` and at most 1 MiB of JSON, one for each ``_id`` and for each key of the unique
    indexes; the lowest stays."""
    out = df.where(F.col("_id").isNotNull() & (F.col("_id").cast("string") != "")).withColumn("_id", F.col("_id").cast("string"))
    out = out.where(size_of(out) <= MAX_BYTES)
    out = first_by(out, ["_id"], [F.to_json(F.struct("*"))])
    for index in unique:
        names = [f"__k{i}" for i in range(len(index.fields))]
        keys = _key(out, index)
        least = keys.groupBy(*names).agg(F.min("_id").alias("__first"))
        same = [keys[n].eqNullSafe(least[n]) for n in names]
        losers = keys.join(least, same).where("_id <> __first").select("_id").distinct()
        out = out.join(losers, "_id", "left_anti")
    return out


def report(df: DataFrame, unique: list[Index] = ()) -> Report:
    n = df.count()
    ids = df.where(F.col("_id").isNotNull() & (F.col("_id").cast("string") != ""))
    good = ids.where(size_of(ids) <= MAX_BYTES)
    a, b, c = ids.count(), good.count(), good.select("_id").distinct().count()
    kept = repaired(df, unique).count()
    return Report(n, n - a, a - b, b - c, c - kept, kept)
