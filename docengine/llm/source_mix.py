"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are to be copied target / source_size times each. The whole part of that is certain; the
fractional part is a probability that dependent rounding turns into 0 or 1. Two open documents at a time trade
mass, measured in words so that the source's expected words stay as they are, until one of them is integral: with
masses x and y out of sizes s and t, the first gains min(s - x, y) or loses min(x, t - y), with the probabilities
that keep both expectations. A group of documents ends with at most one open document. Those residuals are
grouped again, and so on up a reduction tree whose last document of each source goes to the nearer side. Each
source's words are then within half a document of its target.

Random choices are hashes of the ids of the two documents and a seed, groups are hashes of ids, and folds run in
order of hash: reruns agree. Groups hold GROUP rows on average however hot a source is, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.spill import table, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3.0
SEED = 20240607
#: Documents folded together at each level of the tree.
GROUP = 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_REPEATS) -> DataFrame:
    """source, source_size, n, target of each source of ``sizes`` (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``cap`` times its source's size and the excess is shared again by weight among the others: the sources that stop
    are those of the smallest size per weight, so one running sum in that order finds them all.
    """
    from pyspark.sql import Window as W

    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weighed = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    order = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    left = F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    fair = F.greatest(left, F.lit(0.0)) / F.sum("w").over(rest)
    placed = weighed.withColumns({"fair": fair, "place": F.row_number().over(order)})
    placed = placed.withColumn("stops", F.col("w") * F.col("fair") >= cap * F.col("source_size"))
    # Once a source does not stop, none after it does: all of them get the level of the first that does not stop.
    level = F.min(F.when(~F.col("stops"), F.struct("place", "fair"))).over(whole)["fair"]
    target = F.when(F.col("stops"), cap * F.col("source_size")).otherwise(F.col("w") * level)
    return placed.select("source", "source_size", "n", target.cast("double").alias("target"))


def _uniform(seed: int, level: int, a: Column, b: Column) -> Column:
    """A number in [0, 1) that depends on both documents."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), a, b), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(level: int, seed: int) -> Column:
    """Fold the array ``open`` of (h, doc_id, size, whole, x): decided documents and at most one open one.

    x is the open mass in words, 0 < x < size.
    """
    one = "struct<h:bigint,doc_id:bigint,size:bigint,whole:bigint,x:double>"
    start = F.struct(F.lit(None).cast(one).alias("held"), F.lit(None).cast(f"array<{one}>").alias("done"))
    zero = F.struct(start["held"].alias("held"), F.coalesce(start["done"], F.array().cast(f"array<{one}>")).alias("done"))

    def step(acc: Column, doc: Column) -> Column:
        a, b = acc["held"], doc
        up, down = F.least(a["size"] - a["x"], b["x"]), F.least(a["x"], b["size"] - b["x"])
        rises = _uniform(seed, level, a["h"], b["h"]) * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        # The one that the move empties or fills is set exactly; the other keeps the rest.
        a_ends = F.when(rises, a["size"] - a["x"] <= b["x"]).otherwise(a["x"] <= b["size"] - b["x"])
        ax = F.when(a_ends, F.when(rises, a["size"].cast("double")).otherwise(0.0)).otherwise(a["x"] + moved)
        bx = F.when(a_ends, b["x"] - moved).otherwise(F.when(rises, 0.0).otherwise(b["size"].cast("double")))
        open_ = F.when(a_ends, _with(b, bx)).otherwise(_with(a, ax))
        shut = F.when(a_ends, _with(a, ax)).otherwise(_with(b, bx))
        # Equal amounts end both at once.
        over = (open_["x"] <= 0) | (open_["x"] >= open_["size"])
        both = F.struct(
            F.when(~over, open_).cast(one).alias("held"),
            F.concat(acc["done"], F.array(shut), F.when(over, F.array(open_)).otherwise(F.array().cast(f"array<{one}>"))).cast(f"array<{one}>").alias("done"),
        )
        first = F.struct(doc.cast(one).alias("held"), acc["done"].alias("done"))
        return F.when(a.isNull(), first).otherwise(both)

    return F.aggregate(F.array_sort("open"), zero, step)


def _with(doc: Column, x: Column) -> Column:
    return F.struct(doc["h"].alias("h"), doc["doc_id"].alias("doc_id"), doc["size"].alias("size"), doc["whole"].alias("whole"), x.alias("x"))


def mix(documents: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_REPEATS, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text, source): doc_id, size, source_size, target, copies, taken.

    copies times size is ``taken``. Documents of size 0 (null or blank texts) take nothing; a source of nothing else
    has target 0. A null source is a source, last in order. Repeated rows are rows of their own, and so are those without
    a doc_id. Other columns are ignored. An empty table gives no rows.
    """
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    every = documents.select(F.col("doc_id").cast("long"), n_words.alias("size"), "source", F.xxhash64("text").alias("t"))
    # Rows that are alike in all this are told apart by a number, so that no group of the tree fills up with them.
    alike = every.groupBy("doc_id", "size", "source", "t").agg(F.count(F.lit(1)).alias("times"))
    sizes = written(alike.select("doc_id", "size", "source", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"), "t"), "mix-sizes")
    per_source = written(targets(sizes, weights, cap), "mix-targets")
    # Sources are many at most; the join is left to the optimiser, which sees the size of the written table.
    known = sizes.join(per_source, sizes["source"].eqNullSafe(per_source["source"])).select(
        "doc_id", "size", sizes["source"], "source_size", "n", "target", "t", "nth"
    )
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.when(F.abs(share - F.round(share)) < 1e-12, F.round(share)).otherwise(share))
    split = known.withColumns({"whole": whole, "x": F.greatest(share - whole, F.lit(0.0)) * F.col("size")})
    closed = (F.col("x") <= 0) | (F.col("x") >= F.col("size"))
    result = ["doc_id", "size", "source_size", "target", "copies"]
    settled = split.where(closed).withColumn("copies", F.when(F.col("size") > 0, F.col("whole")).otherwise(0)).select(*result)

    most = per_source.agg(F.max("n")).first()[0] or 0
    open_ = split.where(~closed).select(
        "source", "source_size", "n", "target", F.struct(F.xxhash64("doc_id", "t", "nth", F.lit(seed)).alias("h"), "doc_id", "size", "whole", "x").alias("doc")
    )
    level, parts = 0, [settled]
    while most > 0:
        # Level L of a source of n documents has about n / group ** L open ones.
        groups = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / float(group ** (level + 1))))
        folded = (
            open_.withColumn("g", F.pmod(F.xxhash64(F.col("doc")["h"], F.lit(level), F.lit(seed)), groups))
            .groupBy("source", "source_size", "n", "target", "g")
            .agg(F.collect_list("doc").alias("open"))
            .withColumn("out", _fold(level, seed))
            .select("source", "source_size", "n", "target", F.col("out")["held"].alias("doc"), F.col("out")["done"].alias("done"))
        )
        last = most <= group ** (level + 1)
        folded = written(folded, f"mix-level{level}")
        parts.append(_taken(folded.select("source_size", "target", F.explode("done").alias("doc")), F.col("doc")["x"] > 0).select(*result))
        open_ = folded.where("doc is not null").select("source", "source_size", "n", "target", "doc")
        if last:
            doc = F.col("doc")
            rises = doc["x"] * 2 >= doc["size"]
            parts.append(_taken(open_, rises).select(*result))
            break
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumns({"copies": F.col("copies").cast("long"), "taken": (F.col("copies") * F.col("size")).cast("long")})


def _taken(docs: DataFrame, rises: Column) -> DataFrame:
    doc = F.col("doc")
    return docs.select(
        doc["doc_id"].alias("doc_id"), doc["size"].alias("size"), "source_size", "target", (doc["whole"] + rises.cast("long")).alias("copies")
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` by the weights 5, 2 and 1 in turn."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_source_mix": op3_source_mix}
#: Which documents are taken is a random choice; sizes and targets are tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
