"""Intermediate tables in the folder that the cluster shares, and a filter of ids that spares shuffles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.plans.lineage import shared_dir
from docengine.sources import files


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    return Scratch(df.sparkSession, name).write(df, "table")


class Scratch:
    """Tables of one job in a folder of their own, each dropped as soon as what is made from it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            files.delete(self.spark, f"{self.path}/{name}")


#: Bits of the filter of ids that is sent to every executor: 8 MiB, however many ids there are, in rows of FILTER_WORDS
#: times 64 bits.
FILTER_BITS = 1 << 26
FILTER_WORDS = 128


class IdFilter:
    """A set of bits for hashed ids, of fixed size, made on the executors and joined as a broadcast table, so that no text
    goes through a Python worker. A row it lets through may still not be meant; one it holds back is surely not. The more
    ids, the more it lets through: it spares a shuffle or it does not, and never decides a result."""

    def __init__(self, ids: DataFrame):
        slots = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).where("id is not null").select(self._slot("id").alias("s"))
        words = slots.selectExpr("s div 64 as w", "shiftleft(1L, cast(s % 64 as int)) as bit").groupBy("w").agg(F.bit_or("bit").alias("bits"))
        held = words.groupBy(F.expr(f"w div {FILTER_WORDS}").alias("_chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"w % {FILTER_WORDS}"), "bits"))).alias("m"))
        chunks = held.select("_chunk", F.expr(f"transform(sequence(0L, {FILTER_WORDS - 1}L), i -> coalesce(m[i], 0L))").alias("_bits"))
        self.sent = Scratch(ids.sparkSession, "filter").write(chunks, "chunks")

    @staticmethod
    def _slot(key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS))

    def rows(self, df: DataFrame, key: str, *, hit: bool = True) -> DataFrame:
        """Rows of ``df`` that may be meant, or those that surely are not. A null key is never meant."""
        slot = F.when(F.col(key).isNotNull(), self._slot(key))
        placed = df.withColumn("_slot", slot).withColumn("_chunk", F.expr(f"_slot div {64 * FILTER_WORDS}"))
        joined = placed.join(F.broadcast(self.sent), "_chunk", "left")
        there = F.coalesce(F.expr(f"shiftrightunsigned(_bits[cast(_slot div 64 % {FILTER_WORDS} as int)], cast(_slot % 64 as int)) & 1L") == 1, F.lit(False))
        return joined.where(there if hit else ~there).select(*df.columns)


def not_among(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``, or null: only what the filter lets through needs a join."""
    found = IdFilter(ids)
    return found.rows(df, key, hit=False).unionByName(found.rows(df, key).join(ids, key, "left_anti"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
