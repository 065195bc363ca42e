"""Document fingerprints: SpotSigs.

A signature is an anchor, a common word of the text's language or the start of the text, with the next CHAIN words after
it that are not common words. A text's fingerprint is the sorted set of the hashes of its signatures, as eight hex digits
each. Two fingerprints are as alike as their sets' Jaccard similarity.

Near copies, over all rows: (1) equal sets become one class; (2) a class stands under its rarest signatures, a prefix in
an order that puts frequent ones last, of which two near sets share l at least (``least_shared``); a class with fewer than l
that others have too is done with. Each shared signature is labelled with its first row, its head, and a class leaves out
the weakest heads whose signatures are fewer than l in all; (3) the classes of a head are partitioned by set length, so
that a near set lies in the same partition or the next, and a large partition is dealt out in parts; few classes are one
partition; classes of a family that are near by their distances from its centre alone are summed up, and not compared
(``_families``); (4) each part is compared with itself and the others by Jaccard similarity, pruned by set length and by
bits of the sets first, each pair once. Rareness comes from a count sketch of
fixed size; it decides how many classes meet, never which are found.

Everything is DataFrame code: one regular expression finds all runs of common words of a text with the chain behind each,
which is that of every anchor in the run, so time is in proportion to the text; and the next document of each is found in
ranges of doc_id of about equal numbers of rows, so a text is shuffled once and no window spans the table.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docengine.llm.spill import Scratch, table

CHAIN = 2
#: Documents in one range of doc_id on average, and the most ranges.
RANGE_ROWS = 500
MAX_RANGES = 4096
#: Pairs at least so alike are near copies.
NEAR = 0.75
#: Slots of signatures that are counted together.
SKETCH_SLOTS = 1 << 16
#: A prefix is longer by one signature for so many of its set; as many more are shared by near sets.
SHARED_STEP = 10
#: Classes of one head that are compared with one another in one go; more are partitioned by set length, and a partition is
#: dealt out in parts of about so many.
PART_MEMBERS = 256
#: Of classes under one head, more than so many may be a family, in which pairs near by their distances from a centre are summed.
FAMILY_MEMBERS = 16
#: Words of 64 bits that a set is marked in; pairs whose marks differ too much are not compared.
MARK_WORDS = 4
# Common words of English, French, German and Spanish.
COMMON = """the a an and of to in is it be as at by for from with this that are was on or has had not but
le la les un une des du de et est en que qui dans pour sur par au aux ce il elle ne pas son se
der die das den dem ein eine und ist zu von mit auf im nicht sich des als auch es an
el los las una del y que por con para su no al lo como""".split()



def trie(words: list[str]) -> str:
    """A regular expression for any of the words, by common beginnings; a word that goes on is preferred."""
    below: dict[str, list[str]] = {}
    for w in words:
        below.setdefault(w[:1], []).append(w[1:])
    parts = [(r"\^" if c == "^" else c) + trie(rest) for c, rest in sorted(below.items()) if c]
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 and "" not in below else f"(?:{'|'.join(parts)})"
    return f"{body}?" if "" in below else body


def signatures(text: Column) -> Column:
    """The distinct signatures of a text as strings, in no set order."""
    words = F.concat(F.lit(" ^ "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " ")), F.lit(" "))
    run = rf"(?:{trie(sorted({'^', *COMMON}))} )"
    # A run is taken whole also where the text ends before its chain does: none is tried again from its second word.
    chain = rf" ({run}++)(?=(?:{rf'{run}*+'.join([r'([^ ]++) '] * CHAIN)})?)"
    groups = " ".join(f"${i + 2}" for i in range(CHAIN))
    marked = F.split(F.regexp_replace(words, F.lit(chain), F.lit(f" \n$1\t{groups}\n")), "\n")
    every = F.filter(marked, lambda s: s.contains("\t") & ~s.endswith(" "))
    anchors = lambda s: F.array_distinct(F.split(F.rtrim(F.substring_index(s, "\t", 1)), " "))
    signed = F.transform(every, lambda s: F.transform(anchors(s), lambda w: F.concat_ws(" ", w, F.substring_index(s, "\t", -1))))
    return F.array_distinct(F.flatten(signed))


def prints(text: Column) -> Column:
    """Sorted distinct signature hashes, array<int>."""
    return F.array_sort(F.array_distinct(F.transform(signatures(text), lambda s: F.hash(s))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sorted distinct hash arrays; two empty ones are alike only as texts, so 0 here."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def range_of(documents: DataFrame) -> Column:
    """The range of each row's doc_id, from 0 with the smallest ids; -1 for no id. Ranges are cut at approximate quantiles,
    so that they hold about as many rows each, however far ids lie apart."""
    rows = documents.count()
    ranges = min(MAX_RANGES, max(1, rows // RANGE_ROWS))
    bounds: list[int] = []
    if ranges > 1:
        at = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
        found = documents.select(F.expr(f"percentile_approx(doc_id, array({at}), {4 * ranges})")).first()[0]
        bounds = sorted(set(found or []))
    # How many bounds are at most doc_id, by halving.
    listed = f"from_json('{json.dumps(bounds)}', 'array<bigint>')"
    half = "((s.lo + s.hi) div 2)"
    step = f"if(element_at({listed}, cast({half} + 1 as int)) <= doc_id, named_struct('lo', {half} + 1L, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {half}))"
    found = f"aggregate(sequence(1, {len(bounds).bit_length()}), named_struct('lo', 0L, 'hi', {len(bounds)}L), (s, i) -> if(s.lo >= s.hi, s, {step}), s -> s.lo)"
    return F.expr(f"if(doc_id is null, -1L, {found if bounds else '0L'})")


def with_next(documents: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame:
    """Adds ``fp`` from ``sets`` (doc_id, t, fp; ``t`` is the text's hash), and ``next``, a struct of text and fp of the
    document that comes next in descending order of doc_id (ties by text; null ids last); the last one's next is the first.
    Adds what ``near`` (see near_rows) says of a row. All of this goes to the ranges of doc_id with the texts."""
    key = range_of(documents)
    names = {"k": "long", "kind": "int", "doc_id": "long", "t": "long", "text": "string", "fp": "array<int>", "n_near": "long", "near_id": "long"}

    def sent(df: DataFrame, kind: int, **has: str) -> DataFrame:
        given = {"kind": F.lit(kind)} | {c: F.col(x) for c, x in has.items()}
        return df.select(*(given.get(c, F.lit(None)).cast(type_).alias(c) for c, type_ in names.items()))

    keyed = documents.select(key.alias("k"), "doc_id", F.xxhash64("text").alias("t"), "text")
    # The first document of each range follows the last one of the range above. There are MAX_RANGES at most, and one of none.
    tops = keyed.groupBy("k").agg(F.max("doc_id").alias("top"))
    above = W.orderBy("k")
    tops = tops.withColumn("above", F.coalesce(F.lead("k").over(above), F.first("k").over(above.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    tops = Scratch(documents.sparkSession, "spotsigs-tops").write(tops, "tops")
    heads = keyed.join(F.broadcast(tops.withColumnRenamed("k", "k1")), (F.col("k") == F.col("k1")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("above").agg(F.min("text").alias("text")).withColumn("fp", prints(F.col("text")))
    both = sent(keyed, 0, k="k", doc_id="doc_id", t="t", text="text")
    both = both.unionByName(sent(sets.withColumn("k", key), 1, k="k", doc_id="doc_id", t="t", fp="fp"))
    both = both.unionByName(sent(near.withColumn("k", key), 1, k="k", doc_id="doc_id", t="t", n_near="n_near", near_id="near_id"))
    both = both.unionByName(sent(heads, 2, k="above", text="text", fp="fp")).repartition("k")
    same = W.partitionBy("k", "doc_id", "t")
    facts = {"fp": F.first("fp", ignorenulls=True).over(same)} | {c: F.max(c).over(same) for c in ("n_near", "near_id")}
    own = both.withColumns(facts).where("kind <> 1").withColumn("own", F.struct("text", "fp"))
    order = W.partitionBy("k").orderBy("kind", F.desc_nulls_last("doc_id"), "text")
    placed = own.withColumn("next", F.lead("own").over(order)).where("kind = 0")
    return placed.withColumns({"n_near": F.coalesce("n_near", F.lit(0)).cast("long"), "near_id": F.coalesce("near_id", "doc_id")}).drop("k", "kind", "t", "own")


def _ranks(fps: DataFrame) -> bytes:
    """How many rows each slot's signatures are in, as a power of two of the mean; a byte a slot."""
    slots = fps.select(F.explode("fp").alias("h")).select(F.pmod("h", F.lit(SKETCH_SLOTS)).alias("s"))
    counted = slots.groupBy("s").agg(F.count(F.lit(1)).alias("c")).toArrow()
    slots, counts = (counted.column(c).to_pylist() for c in ("s", "c"))
    mean = max(1, sum(counts) // max(len(counts), 1))
    ranks = bytearray(SKETCH_SLOTS)
    for s, c in zip(slots, counts, strict=True):
        ranks[s] = min((c // mean).bit_length(), 255)
    return bytes(ranks)


def marks(fp: str) -> Column:
    """MARK_WORDS times 64 bits, each whether an odd number of the set's hashes fall on it. Two sets' marks differ in at most
    as many bits as the sets have signatures that the other one lacks."""
    one = f"aggregate({fp}, 0L, (x, h) -> if(pmod(shiftright(h, 6), {MARK_WORDS}) = {{}}, x ^ shiftleft(1L, h & 63), x))"
    return F.expr(f"array({', '.join(map(one.format, range(MARK_WORDS)))})")


def least_shared(n: str) -> str:
    """How many prefix signatures near sets share at least, where the smaller set has n; as SQL."""
    return f"(1 + {n} div {SHARED_STEP})"


def _met(sets: DataFrame, classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Which classes may be near which: rep, n, first, members, head, w, their signatures under it, and low, their smaller heads."""
    full = sets.where("size(fp) > 0").select("rid", "fp", F.size("fp").cast("long").alias("n"))
    rank = F.lit(_ranks(full))
    rarest = F.array_sort(F.transform("fp", lambda h: F.struct(F.substring(rank, F.pmod(h, F.lit(SKETCH_SLOTS)) + 1, F.lit(1)).alias("r"), h.alias("h"))))
    common = f"(({percent} * n + 99) div 100)"
    prefix = F.slice(rarest, F.lit(1), F.expr(f"cast(least(n, n - {common} + {least_shared('n')}) as int)"))
    met = full.select("rid", F.explode(prefix).alias("s")).select("rid", F.col("s.h").alias("h"))
    first = met.groupBy("h").agg(F.min("rid").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "head")
    shared = met.join(scratch.write(first, "first"), "h").select(F.col("rid").alias("rep"), "head")
    counted = shared.groupBy("rep", "head").agg(F.count(F.lit(1)).alias("w"))
    own = W.partitionBy("rep")
    named = classes.where("n > 0").withColumn("need", F.expr(least_shared(common)))
    held = counted.join(named, "rep").withColumn("all", F.sum("w").over(own)).where("all >= need").drop("all")
    held = scratch.write(held, "held")
    each = scratch.write(held.groupBy("head").agg(F.count(F.lit(1)).alias("m"), F.avg("w").alias("mean")).where("m > 1").select("head", "mean"), "each")
    worst = own.orderBy("mean", F.col("head").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = held.join(each, "head").withColumn("sum", F.sum("w").over(worst)).where("sum >= need")
    heads = ranked.groupBy("rep", "n", "first", "members").agg(F.array_sort(F.collect_list(F.struct("head", "w"))).alias("heads"))
    heads = heads.withColumn("h", F.explode("heads")).select("rep", "n", "first", "members", "h.head", "h.w", F.col("heads.head").alias("low"))
    return scratch.write(heads.withColumn("low", F.filter("low", lambda h: h < F.col("head"))), "met")


def _centres(kin: DataFrame) -> DataFrame:
    """family, c, centre: the signatures that more than half of the c members of each family of ``kin`` (rep, family, c, fp)
    have; where a family is more than one part, those that parts with more than half of the members have so. A part's sets
    are sorted as one list, in which the signature of k members stands k times in a row, so only what a part's members mostly
    have becomes rows, and not each signature of each member."""
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / float(PART_MEMBERS))).alias("part")
    held = kin.groupBy("family", "c", part).agg(F.count(F.lit(1)).alias("m"), F.sort_array(F.flatten(F.collect_list("fp"))).alias("all"))
    half = F.floor(F.col("m") / 2).cast("int")
    # The list is bound once: a lambda that names the column could compute it anew for each element.
    mostly = F.transform(F.array("all"), lambda a: F.array_distinct(F.filter(a, lambda h, i: F.get(a, i + half) == h)))[0]
    common = held.select("family", "c", "m", F.explode(mostly).alias("h")).groupBy("family", "c", "h").agg(F.sum("m").alias("k")).where("2 * k > c")
    return common.groupBy("family", "c").agg(F.collect_list("h").alias("centre"))


def _families(met: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """rep, members, first, family, s, part, parts of the classes of large heads, each in one family, that of the head it has
    most signatures under. d being how many signatures a set and the family's centre have that the other one lacks, s is
    (100 + percent) * d - (100 - percent) * n. Two sets differ in at most as many as both differ from the centre, so two of
    a family whose s are at most 0 in all are near, without a look at them. The centre, what more than half of the family
    have, decides how many such there are, never whether a pair is near."""
    large = met.where(F.col("m") > FAMILY_MEMBERS).groupBy("rep", "n", "first", "members")
    chosen = scratch.write(large.agg(F.max_by("head", F.struct("w", -F.col("head"))).alias("family")), "chosen")
    counted = scratch.write(chosen.groupBy("family").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > FAMILY_MEMBERS), "counted")
    kin = scratch.write(chosen.join(counted, "family").join(sets.select(F.col("rid").alias("rep"), "fp"), "rep"), "kin")
    centres = scratch.write(_centres(kin), "centres")
    # Families that meet under a head and have nearly one centre go to the largest of them.
    other = centres.select(F.col("family").alias("head"), F.col("c").alias("c2"), F.col("centre").alias("centre2"))
    beside = kin.select("rep", "family").join(met.select("rep", "head"), "rep").where("head <> family").select("family", "head").distinct()
    both = F.size(F.array_intersect("centre", "centre2"))
    alike = 200 * both >= (100 + percent) * (F.size("centre") + F.size("centre2") - both)
    larger = F.struct(F.col("c2"), -F.col("head")) > F.struct(F.col("c"), -F.col("family"))
    moved = beside.join(other, "head").join(centres, "family").where(alike & larger).groupBy("family").agg(F.max_by("head", F.struct("c2", -F.col("head"))).alias("to"))
    moved = centres.select("family").join(moved, "family", "left").select("family", F.coalesce("to", "family").alias("to"))
    kin = kin.drop("c").join(scratch.write(moved, "moved"), "family").drop("family").withColumnRenamed("to", "family")
    parts = F.ceil(F.count(F.lit(1)) / float(PART_MEMBERS)).cast("int").alias("parts")
    dealt = scratch.write(kin.groupBy("family").agg(parts), "dealt")
    kin = kin.join(dealt, "family").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    centre = centres.join(dealt, "family").select("family", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    differ = F.col("n") + F.size("centre") - 2 * F.size(F.array_intersect("fp", "centre"))
    placed = kin.join(centre, ["family", "part"]).withColumn("s", ((100 + percent) * differ - (100 - percent) * F.col("n")).cast("long"))
    return scratch.write(placed.select("rep", "members", "first", "family", "s", "part", "parts"), "families")


def _surely_near(kin: DataFrame) -> DataFrame:
    """rep, others, low_id: for each class of ``kin`` (see _families), how many rows the classes have that are near by s
    alone, and their smallest doc_id. These are sums over the values of s, however many pairs there are."""
    seen = kin.groupBy("family", "s").agg(F.sum("members").alias("others"), F.min("first").alias("low_id"), F.max("parts").alias("parts"))
    asked = seen.select("family", (-F.col("s")).alias("s"), F.lit(0).cast("long").alias("others"), F.lit(None).cast("long").alias("low_id"), "parts")
    steps = seen.unionByName(asked).groupBy("family", "s").agg(F.sum("others").alias("others"), F.min("low_id").alias("low_id"), F.max("parts").alias("parts"))
    upto = W.partitionBy("family").orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = steps.select("family", (-F.col("s")).alias("s"), F.sum("others").over(upto).alias("others"), F.min("low_id").over(upto).alias("low_id"), "parts")
    sums = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = kin.select("rep", "members", "family", "s", "part").join(sums, ["family", "s", "part"])
    own = F.when(F.col("s") <= 0, F.col("members")).otherwise(0)
    return found.select("rep", (F.col("others") - own).alias("others"), "low_id").where("others > 0")


def _candidates(rows: DataFrame, percent: int, families: bool = False) -> DataFrame:
    """a, b: the pairs of each part, or of two, that set lengths and marks allow to be near, each once; with ``families``
    without those that are near by s alone. Pairs are rows, as lists are intersected much faster in rows than within a
    function on lists."""
    rows = rows.withColumn("marks", marks("fp"))
    columns = ["rep", "at", "n", "first", "members", "low", "fp", "marks", *["family", "s"] * families]
    rows = rows.groupBy("head", "lo", "hi").agg(F.collect_list(F.struct(*columns)).alias("held"))

    def maybe(a: Column) -> Column:
        def allowed(b: Column) -> Column:
            apart = (a["rep"] < b["rep"]) & ((F.col("lo") == F.col("hi")) | (a["at"] != b["at"]))
            lengths = 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
            if families:
                apart &= ~((a["family"] >= 0) & (a["family"] == b["family"]) & (a["s"] + b["s"] <= 0))
            differ = reduce(add, [F.bit_count(a["marks"][i].bitwiseXOR(b["marks"][i])) for i in range(MARK_WORDS)])
            # A pair that meets under several heads is taken under the smallest.
            return apart & lengths & ((100 + percent) * differ <= (100 - percent) * (a["n"] + b["n"])) & ~F.arrays_overlap(a["low"], b["low"])

        return F.filter("held", allowed)

    each = rows.select(F.explode(F.transform("held", lambda a: F.struct(a.alias("a"), maybe(a).alias("maybe")))).alias("x"))
    return each.where("size(x.maybe) > 0").select("x.a", F.explode("x.maybe").alias("b"))


def near_classes(sets: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """rep, others, low_id of the ``classes`` that have near ones: how many rows those have, and their smallest doc_id."""
    percent = round(100 * NEAR)
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    met = _met(sets, classes, scratch, percent)
    several = met.groupBy("head").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = scratch.write(met.join(several, "head"), "several")
    kin = _families(met, sets, scratch, percent)
    met = met.join(kin.select("rep", "family", "s"), "rep", "left").withColumns({"family": F.coalesce("family", F.lit(-1)), "s": F.coalesce("s", F.lit(0))})
    # Members of a family whose s is at most 0 are all near one another: under a head they need the others only.
    met = met.withColumn("tag", F.when(F.col("s") <= 0, F.col("family")).otherwise(-1))
    tags = met.where("tag >= 0").groupBy("head", "tag").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > FAMILY_MEMBERS).select("head", "tag", F.lit(True).alias("many"))
    met = met.join(scratch.write(tags, "tags"), ["head", "tag"], "left").withColumn("tag", F.when(F.col("many"), F.col("tag")).otherwise(-1)).drop("many")
    met = scratch.write(met.withColumn("length", F.when(F.col("m") > PART_MEMBERS, own).otherwise(-9)).drop("m", "w"), "placed")
    sizes = met.groupBy("head", "length", "tag").agg(F.ceil(F.count(F.lit(1)) / float(PART_MEMBERS)).cast("int").alias("parts"))
    sizes = sizes.groupBy("head").agg(F.collect_list(F.struct("length", "tag", "parts")).alias("groups"))
    dealt = met.join(scratch.write(sizes, "sizes"), "head")
    parts = F.expr("filter(groups, g -> g.length = length and g.tag = tag)[0].parts")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    # Against every part of its own length partition, and of the next shorter and longer ones.
    met_by = "filter(groups, g -> abs(g.length - length) <= 1 and (g.tag < 0 or g.tag <> tag))"
    others = f"flatten(transform({met_by}, g -> transform(sequence(1, g.parts), p -> struct(g.length as length, g.tag as tag, p - 1 as part))))"
    dealt = dealt.withColumn("at", F.struct("length", "tag", "part")).withColumn("other", F.explode(F.expr(others)))
    squares = dealt.select("head", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "at", "rep", "n", "first", "members", "low", "family", "s")
    squares = scratch.write(squares, "squares")
    met = _candidates(squares.join(sets.select(F.col("rid").alias("rep"), "fp"), "rep"), percent, families=True)
    both = F.size(F.array_intersect("a.fp", "b.fp"))
    near = met.where(100 * both >= percent * (F.col("a.n") + F.col("b.n") - both))
    sides = [F.struct(F.col(f"{x}.rep").alias("rep"), F.col(f"{y}.members").alias("others"), F.col(f"{y}.first").alias("low_id")) for x, y in ("ab", "ba")]
    each = near.select(F.explode(F.array(*sides)).alias("x")).select("x.*").unionByName(_surely_near(kin))
    return each.groupBy("rep").agg(F.sum("others").alias("others"), F.min("low_id").alias("low_id"))


def sets_of(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, doc_id, t, fp and two hashes c1, c2 of the class of each row (doc_id, text), written; ``t`` is the text's hash."""
    sets = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("t"), "text", prints(F.col("text")).alias("fp"))
    # Texts without signatures are near only to equal ones.
    blank = F.when(F.size("fp") == 0, F.sha2(F.col("text").cast("binary"), 256))
    sets = sets.withColumns({"c1": F.xxhash64("fp", blank), "c2": F.xxhash64(F.lit(1), "fp", blank)})
    return scratch.write(sets.drop("text"), "sets")


def near_rows(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, t, n_near, near_id of the rows of ``sets`` that have near rows."""
    classes = sets.groupBy("c1", "c2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"), F.max(F.size("fp")).cast("long").alias("n"))
    classes = scratch.write(classes, "classes")
    near = near_classes(sets, classes.drop("c1", "c2"), scratch)
    counts = classes.join(near, "rep", "left").withColumn("n_near", F.col("members") - 1 + F.coalesce("others", F.lit(0))).where("n_near > 0")
    counts = counts.select("c1", "c2", "n_near", F.least("first", "low_id").alias("near_id"))
    rows = sets.select("c1", "c2", "doc_id", "t").join(scratch.write(counts, "counts"), ["c1", "c2"]).select("doc_id", "t", "n_near", F.least("near_id", "doc_id").alias("near_id"))
    rows = scratch.write(rows, "rows")
    scratch.drop("classes", "first", "held", "each", "met", "several", "chosen", "counted", "kin", "centres", "moved", "dealt", "families", "tags", "placed", "sizes", "squares", "counts")
    return rows


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_near, near_id, n_signatures. ``n_near`` other rows of the table are at least NEAR alike, and
    ``near_id`` is the smallest doc_id of them and itself; near_edited and near_next are likenesses of any height.

    The edited text has the last half of the code points replaced by as many of the next document's first ones. Null
    texts are empty. Texts without signatures have an empty fingerprint, which is like an equal text's (1) and like no
    other's (0). An only document is its own next. Other columns are ignored; an empty table gives no rows.
    """
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scratch = Scratch(documents.sparkSession, "spotsigs")
    sets = sets_of(own, scratch)
    near = with_next(own, sets, near_rows(sets, scratch)).withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - half), F.substring(F.col("next.text"), F.lit(1), half))
    made = near.withColumn("edited", edited)
    made = made.select("doc_id", "text", "edited", "n", "fp", prints(F.col("edited")).alias("efp"), "next", "n_near", "near_id")
    return made.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        _near("text", "edited", "fp", "efp").alias("near_edited"),
        _near("text", "next.text", "fp", "next.fp").alias("near_next"),
        "n_near",
        "near_id",
        F.size("fp").cast("long").alias("n_signatures"),
    )


def _near(a: str, b: str, fa: str, fb: str) -> Column:
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(likeness(F.col(fa), F.col(fb)))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, n_near and near_id of fingerprints over all of ``documents``."""
    return fingerprints(table(spark, sf_dir, "documents")).drop("n_signatures")


QUERIES = {"op9_spotsigs": op9_spotsigs}
#: The chains need look-ahead, which DuckDB's expressions lack; tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
