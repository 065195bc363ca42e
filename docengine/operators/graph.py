"""Graphs over edge tables (``_id``, ``_from``, ``_to``, properties): neighbours, breadth-first walks, shortest paths.

A walk is a loop over levels: the frontier is joined to the edges, new vertices are those not seen before, and each level
is written out, so the plan of a level does not hold those before it. Neighbours are taken in order of their ids, so the
order of discovery within a level is the order of paths, and each vertex keeps the smallest path that reaches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.errors import BadFilterError
from docengine.plans.lineage import cut

OUT, IN, BOTH = "out", "in", "both"
MAX_DEPTH, MAX_LIMIT = 32, 100_000


def edge_collection(edge_type: str) -> str:
    if not isinstance(edge_type, str) or not edge_type or any(ch.isspace() for ch in edge_type):
        raise BadFilterError("an edge type is a name without spaces")
    return f"edges.{edge_type}"


def check_edge(start: str, end: str) -> None:
    if not start or not end:
        raise BadFilterError("an edge has two ends")


def links_of(edges: DataFrame, direction: str = OUT) -> DataFrame:
    """(src, dst) in the direction asked for, repeated edges as they are; edges without both ends are left out."""
    if direction not in (OUT, IN, BOTH):
        raise BadFilterError("direction is out, in or both")
    real = edges.where("_from is not null and _to is not null and _from <> '' and _to <> ''")
    forth = real.select(F.col("_from").alias("src"), F.col("_to").alias("dst"))
    back = real.select(F.col("_to").alias("src"), F.col("_from").alias("dst"))
    return forth if direction == OUT else back if direction == IN else forth.unionByName(back)


def steps(edges: DataFrame, direction: str = OUT) -> DataFrame:
    """Distinct (src, dst) of ``links_of``."""
    return links_of(edges, direction).distinct()


def neighbors(edges: DataFrame, vertex: str, direction: str = OUT) -> DataFrame:
    """vertex: the distinct neighbours, sorted. The filter on the vertex reaches the scan."""
    real = edges.where("_from is not null and _to is not null and _from <> '' and _to <> ''")
    forth = real.where(F.col("_from") == vertex).select(F.col("_to").alias("vertex"))
    back = real.where(F.col("_to") == vertex).select(F.col("_from").alias("vertex"))
    found = forth if direction == OUT else back if direction == IN else forth.unionByName(back)
    return found.distinct().orderBy("vertex")


def incident(edges: DataFrame, vertex: str) -> DataFrame:
    """Edges at a vertex with their properties, a direction tag and the other end."""
    out = edges.where(F.col("_from") == vertex).withColumn("direction", F.lit(OUT)).withColumn("neighbor", F.col("_to"))
    back = edges.where(F.col("_to") == vertex).withColumn("direction", F.lit(IN)).withColumn("neighbor", F.col("_from"))
    return out.unionByName(back)


def _depth(asked: int, default: int) -> int:
    return default if asked <= 0 else min(asked, MAX_DEPTH)


def _levels(edges: DataFrame, start: str, direction: str, depth: int, stop: str | None = None):
    """Yields each level's (vertex, depth, path), the start first. A level is one scan of the edges, of two columns, joined
    to the level before; only levels are written."""
    spark = edges.sparkSession
    # What is seen is the union of the levels, each a written table; there are at most MAX_DEPTH of them.
    level = spark.createDataFrame([(start, 0, [start])], "vertex string, depth int, path array<string>")
    seen = level.select("vertex")
    yield level
    for d in range(1, depth + 1):
        links = links_of(edges, direction)
        reached = links.join(level.select(F.col("vertex").alias("at"), "path"), F.col("at") == F.col("src")).select(F.col("dst").alias("vertex"), F.concat("path", F.array("dst")).alias("path"))
        # Parallel edges and several ways to a vertex fall together before anything is shuffled.
        new = reached.groupBy("vertex").agg(F.min("path").alias("path")).join(seen, "vertex", "left_anti")
        level = cut(new.select("vertex", F.lit(d).alias("depth"), "path"), "graph-level")
        if level.isEmpty():
            return
        yield level
        if stop is not None and not level.where(F.col("vertex") == stop).isEmpty():
            return
        seen = seen.unionByName(level.select("vertex"))


def traverse(edges: DataFrame, start: str, *, direction: str = OUT, min_depth: int = 0, max_depth: int = 0, limit: int = 0) -> DataFrame:
    """(vertex, depth) breadth first, in order of discovery; the start has depth 0. min_depth only hides rows; a
    max_depth of 0 is 5 and at most 32; a limit of 0 is 10,000 and at most 100,000 vertices. The walk ends at the level
    that fills the limit."""
    most = min(limit, MAX_LIMIT) if limit > 0 else 10_000
    found, n = None, 0
    for d, level in enumerate(_levels(edges, start, direction, _depth(max_depth, 5))):
        found = level if found is None else found.unionByName(level)
        n += level.count() if d >= min_depth else 0
        if n >= most:
            break
    return found.where(F.col("depth") >= min_depth).orderBy("depth", "path").limit(most).select("vertex", "depth")


def shortest_path(edges: DataFrame, start: str, end: str, *, max_depth: int = 0, direction: str = OUT) -> list[str] | None:
    """Vertices of the first shortest path, or None; ``[start]`` if both ends are one. Outgoing edges unless asked."""
    if start == end:
        return [start]
    for level in _levels(edges, start, direction, _depth(max_depth, 6), stop=end):
        row = level.where(F.col("vertex") == end).first()
        if row is not None:
            return list(row["path"])
    return None


def resolve_ids(ids: DataFrame, collections: dict[str, DataFrame]) -> DataFrame:
    """_id, collection, doc (JSON) of each id in ``ids`` (_id) from the first collection, by name, that has it."""
    found = None
    for rank, (name, df) in enumerate(sorted((n, d) for n, d in collections.items() if not n.startswith(("edges.", "_")))):
        part = df.join(ids.select("_id").distinct(), "_id", "left_semi")
        part = part.select("_id", F.lit(rank).alias("r"), F.lit(name).alias("collection"), F.to_json(F.struct("*")).alias("doc"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return ids.select("_id", F.lit(None).cast("string").alias("collection"), F.lit(None).cast("string").alias("doc")).limit(0)
    best = found.groupBy("_id").agg(F.min_by(F.struct("collection", "doc"), "r").alias("b"))
    return best.select("_id", "b.collection", "b.doc")


def meta(names: list[str]) -> dict[str, list[str]]:
    """Edge types and vertex collections among collection names."""
    edges = sorted(n[len("edges.") :] for n in names if n.startswith("edges."))
    return {"edge_types": edges, "collections": sorted(n for n in names if not n.startswith(("edges.", "_")))}
