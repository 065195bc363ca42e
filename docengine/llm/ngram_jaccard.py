"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

Count vectors bound overlaps: a set's shingles are hashed into GROUPS groups, the group counts are a point, and the
overlap of two sets is at most the sum of the smaller count in each group. Points lie in R-trees, whose nodes hold the
largest count of each group below them and the smallest and largest set: a tree is joined with itself from the root
down, a pair of nodes whose summed minima are too low for the smallest sets below them is left out whole, and pairs of
points that survive are verified on the shingle sets.

Which points share a tree is decided exactly, by the rarest shingles. Two linked sets have at least ceil(0.75 n) shingles
in common, n being the larger one's number. In any one order of all shingles, the first l of these are therefore among
the first n - ceil(0.75 n) + l of either set, its prefix; l grows with n (``least_shared``). The order puts frequent
shingles last, by a count sketch of fixed size over the whole corpus; it decides how many points meet, never which
links are found.

Steps:
(1) Equal sets become one class, kept by its smallest doc_id.
(2) Prefix shingles that only one class has are dropped; a class with fewer than l others has no link, and that is most
    classes. Every other shingle is labelled with its first class, its head.
(3) A class goes to the trees of its heads. It may leave out those whose shingles are fewer than l in all: the heads of
    the fewest shingles a member, in an order that is the same for all classes, so that the first head that two linked
    classes share is left out by neither.
(4) In each tree pairs are found and verified; a pair that meets in several trees counts in the one of the smallest head.
    A tree of many members or long texts is dealt out in squares of one part of it against another.
(5) Each tree gives, for every class, the documents linked with it and the smallest class that links lead to. Their sums
    and connected components are the result; no pairs are listed, unless asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docengine.llm import bytewords as bw
from docengine.llm.components import components
from docengine.llm.spill import IdFilter, Scratch, not_among, table

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= 75 * union.
PERCENT = 75
GROUPS = 256
SKETCH_SLOTS = 1 << 20
SKETCH_CHUNK = 1 << 14
#: A prefix is longer by one shingle for so many of its set; as many more are shared by links.
SHARED_STEP = 20
LEAF = 16
#: Parts of a tree hold about so many members, and so many shingles, at most.
PART_MEMBERS = 1024
PART_SHINGLES = 1 << 21
#: Shingles that intersections are counted over at once.
STRIP = 4096


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the bounds of each text's. A text of fewer words, but not none,
    has one: all its words."""
    low = bw.LOWER[data]
    starts, ends, text_of = bw.spans(bw.SOLID[low], offsets)
    words = bw.hashes(low, starts, ends)
    n = len(offsets) - 1
    gram, at = bw.grams(words, text_of, k)
    counts = np.bincount(text_of, minlength=n)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        first = (np.cumsum(counts) - counts)[few]
        h = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            live = counts[few] > j
            h[live] = h[live] * np.uint64(0x9E3779B97F4A7C15) + words[(first + j)[live]]
        gram = np.concatenate([gram, bw.mixed(h + counts[few].astype(np.uint64))])
        owner = np.concatenate([text_of[at], few])
    else:
        owner = text_of[at]
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[keep], owner[keep]
    return gram, np.searchsorted(owner, np.arange(n + 1))


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_SLOTS, np.uint32)
        for _, data, offsets in bw.blocks(batches):
            gram, _ = shingles(data, offsets, k)
            total += np.bincount((gram % np.uint64(SKETCH_SLOTS)).astype(np.int64), minlength=SKETCH_SLOTS).astype(np.uint32)
        yield from _chunks({i: c for i, c in enumerate(total.reshape(-1, SKETCH_CHUNK)) if c.any()})

    return run


def _chunks(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i, c in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([c.astype("<u4").tobytes()], pa.binary())], names=["chunk", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(c, "<u4")
            held[i] = held[i] + got if i in held else got
    yield from _chunks(held)


def sketch(texts: DataFrame, k: int) -> np.ndarray:
    """How many documents each of SKETCH_SLOTS slots of shingles is in, as a rough power of two. Fixed size; tasks' counts
    are added up chunk by chunk, streaming."""
    counted = texts.mapInArrow(bw.handing_back(_count(k)), "chunk int, counts binary")
    total = np.zeros(SKETCH_SLOTS, np.uint32)
    for row in counted.repartition("chunk").mapInArrow(bw.handing_back(_add), "chunk int, counts binary").toLocalIterator():
        total[row["chunk"] * SKETCH_CHUNK :][:SKETCH_CHUNK] = np.frombuffer(row["counts"], "<u4")
    # Slots that hold what the mean one does, by chance, rank alike.
    return np.floor(np.log2(np.maximum(total / max(float(total.mean()), 1.0), 2.0))).astype(np.uint8)


def least_shared(n):
    """How many prefix shingles linked sets share at least, where the smaller set has n."""
    return 1 + n // SHARED_STEP


def digests(gram: np.ndarray, bound: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    key = np.stack([bw.mixed(gram), bw.mixed(gram ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
    sums = np.zeros((len(gram) + 1, 2), np.uint64)
    np.cumsum(key, 0, out=sums[1:])
    return [struct.pack("<QQ", a, b) for a, b in (sums[bound[1:]] - sums[bound[:-1]]).tolist()]


def _points(sent, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank: np.ndarray = sent.value
        for rows, data, offsets in bw.blocks(batches):
            gram, bound = shingles(data, offsets, k)
            n = np.diff(bound)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((gram, rank[(gram % np.uint64(SKETCH_SLOTS)).astype(np.int64)], owner))
            common = -(-percent * n // 100)
            length = np.minimum(n, n - common + least_shared(n)) * (n > 0)
            inside = np.arange(len(gram)) - np.repeat(bound[:-1], n) < np.repeat(length, n)
            prefix = gram[order][inside].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(least_shared(common), pa.int64()),
                    pa.array(digests(gram, bound), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(prefix, pa.int64())),
                ],
                names=["doc_id", "n", "need", "digest", "prefix"],
            )

    return run


class Tree:
    """An R-tree over count vectors, packed by halving at the median of the group whose counts differ most."""

    def __init__(self, points: np.ndarray, n: np.ndarray, at: np.ndarray | None = None):
        self.at = np.arange(len(n)) if at is None else at
        own = points[self.at]
        self.top, self.least, self.most = own.max(0), int(n[self.at].min()), int(n[self.at].max())
        self.below: list[Tree] = []
        if len(self.at) > LEAF:
            spread = own.max(0) - own.min(0)
            by = n[self.at] if self.most - self.least >= spread.max() else own[:, int(spread.argmax())]
            order = self.at[np.argsort(by, kind="stable")]
            self.below = [Tree(points, n, half) for half in np.array_split(order, 2)]


def plausible(points: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The pairs that the tree's bounds allow, as a symmetric matrix."""
    ok = np.zeros((len(n), len(n)), bool)
    root = Tree(points, n)
    todo = [(root, root)]
    while todo:
        a, b = todo.pop()
        if 100 * min(a.most, b.most) < percent * max(a.least, b.least):
            continue
        if int(np.minimum(a.top, b.top).sum()) * (100 + percent) < percent * (a.least + b.least):
            continue
        if a.below and (len(a.at) >= len(b.at) or not b.below):
            if a is b:
                todo += [(a.below[0], a.below[0]), (a.below[1], a.below[1]), (a.below[0], a.below[1])]
            else:
                todo += [(half, b) for half in a.below]
        elif b.below:
            todo += [(a, half) for half in b.below]
        else:
            bound = np.minimum(points[a.at][:, None], points[b.at][None]).sum(2, dtype=np.int64)
            x, y = n[a.at][:, None], n[b.at][None]
            allowed = (bound * (100 + percent) >= percent * (x + y)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            ok[np.ix_(a.at, b.at)] |= allowed
            ok[np.ix_(b.at, a.at)] |= allowed.T
    return ok


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two sets share."""
    n = np.array([len(x) for x in sets])
    gram, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    several = count > 1
    at = (np.cumsum(several) - 1)[column]
    owner, at = owner[several[column]], at[several[column]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(several.sum()), STRIP):
        i, j = np.searchsorted(at, [low, low + STRIP])
        has = np.zeros((len(sets), min(STRIP, int(several.sum()) - low)), np.float32)
        has[owner[i:j], at[i:j] - low] = 1
        both += (has @ has.T).astype(np.int64)
    return both


def _groups(labels: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The smallest label that each row of a symmetric matrix reaches."""
    while True:
        least = np.minimum(labels, np.where(ok, labels[None, :], labels.max()).min(1))
        if (least == labels).all():
            return labels
        labels = least


class _Members:
    """What one task holds of one tree: a part of it, or two."""

    def __init__(self, crossed: bool):
        self.crossed = crossed
        self.doc, self.size, self.part, self.low, self.digest, self.sets = [], [], [], [], [], []
        self.known: set[tuple[int, bytes]] = set()

    def add(self, doc: int, size: int, part: int, low: list[int], digest: bytes, shingled: np.ndarray) -> None:
        if (doc, digest) not in self.known:
            self.known.add((doc, digest))
            for held, x in zip((self.doc, self.size, self.part, self.low, self.digest, self.sets), (doc, size, part, low, digest, shingled), strict=True):
                held.append(x)

    def links(self, percent: int) -> np.ndarray:
        """The links that count here, as a symmetric matrix."""
        n, doc, part = (np.array(x, np.int64) for x in ([len(x) for x in self.sets], self.doc, self.part))
        ok = np.ones((len(n), len(n)), bool)
        points = np.zeros((len(n), GROUPS), np.int32)
        for i, x in enumerate(self.sets):
            points[i] = np.bincount((x >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
        ok = plausible(points, n, percent) & (doc[:, None] != doc[None, :])
        if self.crossed:
            ok &= part[:, None] != part[None, :]
        if any(self.low):
            heads, column = np.unique(np.concatenate([np.array(x, np.int64) for x in self.low]), return_inverse=True)
            has = np.zeros((len(n), len(heads)), np.float32)
            has[np.repeat(np.arange(len(n)), [len(x) for x in self.low]), column] = 1
            ok &= has @ has.T == 0
        # Verified apart wherever no plausible pair ties them together.
        group = _groups(np.arange(len(n)), ok)
        for g in np.unique(group[ok.any(1)]).tolist():
            at = np.flatnonzero(group == g)
            both = intersections([self.sets[i] for i in at.tolist()])
            ok[np.ix_(at, at)] &= (100 * both >= percent * (n[at][:, None] + n[at][None] - both)) & (both > 0)
        return ok

    def counts(self, percent: int) -> pa.RecordBatch:
        ok = self.links(percent)
        root = _groups(np.array(self.doc, np.int64), ok)
        others = ok @ np.array(self.size, np.int64)
        some = np.flatnonzero(ok.any(1)).tolist()
        columns = [
            pa.array([self.digest[i] for i in some], pa.binary()),
            pa.array([self.doc[i] for i in some], pa.int64()),
            pa.array(root[some], pa.int64()),
            pa.array(others[some], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["digest", "rep", "root", "others"])

    def pairs(self, percent: int) -> pa.RecordBatch:
        i, j = np.nonzero(self.links(percent))
        doc = np.array(self.doc, np.int64)
        once = doc[i] < doc[j]
        return pa.RecordBatch.from_arrays([pa.array(doc[i][once]), pa.array(doc[j][once])], names=["a", "b"])


def _joined(k: int, percent: int, what):
    """Rows (head, lo, hi, rep, size, part, low, digest, text), those of one square together: what ``what`` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, None
        for rows, data, offsets in bw.blocks(batches):
            gram, bound = shingles(data, offsets, k)
            own = digests(gram, bound)
            for i, (*square, rep, size, part, low, digest) in enumerate(zip(*(rows.column(x).to_pylist() for x in range(8)), strict=True)):
                if square != key:
                    if members is not None:
                        yield what(members, percent)
                    key, members = square, _Members(square[1] != square[2])
                if own[i] == digest:  # else another text of the same doc_id
                    members.add(rep, size, part, low, digest, gram[bound[i] : bound[i + 1]].copy())
        if members is not None:
            yield what(members, percent)

    return run


class Join:
    """The steps of the join over ``documents`` (doc_id, text). Rows without a doc_id have no class and no links."""

    def __init__(self, documents: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT):
        self.spark, self.k, self.percent = documents.sparkSession, k, percent
        self.scratch = Scratch(self.spark, "jaccard")
        self.texts = documents.selectExpr("cast(doc_id as long) as doc_id", "text")
        rank = self.spark.sparkContext.broadcast(sketch(self.texts, k))
        kinds = "doc_id long, n long, need long, digest binary, prefix array<long>"
        points = self.scratch.write(self.texts.mapInArrow(bw.handing_back(_points(rank, k, percent)), kinds), "points")
        keyed = points.select("doc_id", "n", "need", "digest")
        full = keyed.where("n > 0 and doc_id is not null")
        sizes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.min("n").alias("n"), F.min("need").alias("need"))
        #: Classes of equal sets: digest, rep, size, n, need.
        self.classes = self.scratch.write(sizes, "classes")
        several = self.classes.where("size > 1").select("digest", "rep", "size")
        rep = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("rep", "doc_id"))
        placed = keyed.join(several, "digest", "left").select("doc_id", "n", "digest", rep.alias("rep"), F.coalesce("size", F.lit(1)).alias("size"))
        #: One row a document: doc_id, n, digest, rep, size.
        self.placed = self.scratch.write(placed, "placed")
        self.squares = self._squares(points)

    def _squares(self, points: DataFrame) -> DataFrame:
        """Which part of which tree each class is in, and against which: head, lo, hi, rep, size, part, low, digest."""
        keep = self.scratch.write
        toks = points.where("n > 0 and doc_id is not null").select("doc_id", F.explode("prefix").alias("tok"))
        first = toks.groupBy("tok").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
        shared = toks.join(keep(first.select("tok", "head"), "first"), "tok").select(F.col("doc_id").alias("rep"), "head")
        counted = keep(shared.groupBy("rep", "head").agg(F.count(F.lit(1)).alias("w")), "counted")
        self.scratch.drop("points", "first")
        # Copies of a class share its shingles without being links: only classes go on.
        own = W.partitionBy("rep", "digest")
        held = counted.join(self.classes, "rep").withColumn("all", F.sum("w").over(own)).where("all >= need")
        held = keep(held.select("rep", "digest", "size", "n", "need", "head", "w"), "held")
        each = keep(held.groupBy("head").agg(F.count(F.lit(1)).alias("m"), F.avg("w").alias("mean")).where("m > 1"), "each")
        worst = own.orderBy("mean", F.col("head").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
        ranked = held.join(each, "head").withColumn("sum", F.sum("w").over(worst)).where("sum >= need")
        heads = ranked.groupBy("rep", "digest", "size", "n").agg(F.array_sort(F.collect_list("head")).alias("heads"))
        heads = keep(heads.withColumn("head", F.explode("heads")), "heads")
        lowest = F.col("heads")[0]
        trees = heads.groupBy("head").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"), F.min(lowest).alias("from"), F.max(lowest).alias("to"))
        # All of a tree's members that share a smaller head are looked at there.
        trees = trees.where("m > 1 and not (from = to and from < head)")
        parts = F.greatest(F.ceil(F.col("m") / F.lit(float(PART_MEMBERS))), F.ceil(F.col("all") / F.lit(float(PART_SHINGLES)))).cast("int")
        trees = keep(trees.select("head", parts.alias("parts")), "trees")
        dealt = heads.join(trees, "head").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        low = F.filter("heads", lambda h: h < F.col("head"))
        squares = dealt.select("head", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "rep", "size", "part", low.alias("low"), "digest")
        squares = keep(squares, "squares")
        self.scratch.drop("counted", "held", "each", "heads", "trees")
        return squares

    def _run(self, what, kinds: str) -> DataFrame:
        texts = IdFilter(self.squares.select("rep")).rows(self.texts, "doc_id").withColumnRenamed("doc_id", "rep")
        rows = self.squares.join(texts, "rep").select(*self.squares.columns, "text")
        rows = rows.repartition("head", "lo", "hi").sortWithinPartitions("head", "lo", "hi")
        return rows.mapInArrow(bw.handing_back(_joined(self.k, self.percent, what)), kinds)

    def pairs(self) -> DataFrame:
        """a, b (a < b): every link between classes of different sets, once, by their representatives."""
        return self._run(_Members.pairs, "a long, b long").distinct()

    def classes_linked(self) -> DataFrame:
        """One row a document: doc_id, n_shingles, component_id, n_links."""
        linked = self.scratch.write(self._run(_Members.counts, "digest binary, rep long, root long, others long"), "linked")
        equal = self.placed.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        comps = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(equal))
        others = linked.groupBy("digest").agg(F.sum("others").alias("others"))
        counted = self.placed.join(others, "digest", "left")
        n_links = F.when(F.col("rep").isNotNull(), F.col("size") - 1 + F.coalesce("others", F.lit(0))).otherwise(0)
        placed = counted.select("doc_id", "n", n_links.cast("long").alias("n_links")).join(comps, F.col("doc_id") == F.col("node"), "left")
        return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "n_links")


def jaccard_classes(documents: DataFrame, *, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, n_links.

    Null and wordless texts have 0 shingles and no links, and are a component of their own. Rows of one doc_id are one
    document for components; each keeps its own row and count. n_links is the number of other rows that a row's set is
    linked with, those of its own doc_id left out only where their sets differ. Rows without a doc_id have no links and
    a null component. Other columns are ignored; an empty table gives no rows.
    """
    return Join(documents, k, percent).classes_linked()


def linked_pairs(documents: DataFrame, *, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """a, b (a < b) of every link between classes of different sets, by the smallest doc_id of each class; the members of
    a class are the rows of one text. The table has as many rows as there are links, which may be the square of a group."""
    return Join(documents, k, percent).pairs()


def keep_one(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``documents``, with all columns, that stay when one document of each component does: the one of the
    smallest doc_id, and of several rows with that id the first by text. Rows without an id are in no component and stay."""
    scratch = Scratch(documents.sparkSession, "jaccard-kept")
    classes = scratch.write(classes.select("doc_id", "component_id"), "classes").where("doc_id is not null")
    gone = scratch.write(classes.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    several = scratch.write(classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "several")
    kept = not_among(documents, gone)
    if several.isEmpty():
        return kept
    first = W.partitionBy("doc_id").orderBy("text")
    once = kept.join(several, "doc_id", "left_semi").withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row")
    return kept.join(several, "doc_id", "left_anti").unionByName(once)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns and n_links of jaccard_classes over all of ``documents``."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents") -> str:
    """Brute force for DuckDB: all pairs that share a shingle, then components by a recursive walk."""
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x20\x09-\x0D]+')"
    )
    k = SHINGLE_WORDS
    return f"""
with recursive d as (select doc_id, {words} as w from {documents}),
s as (select distinct doc_id, array_to_string(w[i : i + {k} - 1], ' ') as g
  from d, unnest(range(1, 1 + greatest(len(w) - {k} + 1, 1))) as r(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * p.shared >= {PERCENT} * (x.n + y.n - p.shared)),
walk(doc_id, seen) as (select a, a from e union select walk.doc_id, e.b from walk join e on e.a = walk.seen)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles,
  cast(least(d.doc_id, coalesce(m.c, d.doc_id)) as bigint) as component_id, cast(coalesce(l.n_links, 0) as bigint) as n_links
from d left join n using (doc_id) left join (select doc_id, min(seen) as c from walk group by 1) m using (doc_id)
  left join (select a as doc_id, count(*) as n_links from e group by 1) l using (doc_id)"""


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLE_SQL = {"op5_ngram_jaccard": oracle()}
