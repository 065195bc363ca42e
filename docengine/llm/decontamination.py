"""Benchmark decontamination by winnowing.

A training text and a benchmark text that share 13 consecutive words also share, for k = 5 and windows of
w = 9 k-grams, at least one winnowed fingerprint: the smallest k-gram hash of each window of w is kept on both
sides, and 13 = w + k - 1 words hold exactly one such window. Fingerprints of the two sides are joined; each hit is
extended to every window of 13 words around it, and those that the benchmark has are shared passages. A window is looked
up once for each text however often it stands there or in an item, so texts of few different words cost no more than
others. Items of fewer words than a window are one window each and are looked up whole.

The benchmark's index goes to the executors in blocks of at most ``block_bytes`` of text, so what is sent at once has a
fixed bound however large the benchmark is; with more than one block, each is a pass of its own over the documents, whose
rows are written in between. Documents are never shuffled, so hot sources, copies and passages cannot skew anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bytewords as bw
from docengine.llm.spill import Scratch, table

WINDOW_WORDS = 13
GRAM_WORDS = 5
#: 5 % of a document's words.
CONTAMINATED_SHARE = (1, 20)
BLOCK_BYTES = 16 << 20


@dataclass
class Index:
    """Fingerprints of one block of benchmark texts."""

    window: int
    k: int
    ids: list[str] = field(default_factory=list)
    #: Different fingerprints, sorted.
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: Hashes of whole windows, sorted, and an item of each; once for each item.
    whole: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Word count -> (sorted hashes of whole items, the item of each).
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = bw.LOWER[data]
    starts, ends, text_of = bw.spans(bw.ALNUM[lower], offsets)
    return bw.hashes(lower, starts, ends), text_of


def winnowed(words: np.ndarray, text_of: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The rightmost smallest k-gram hash of each run of window - k + 1 k-grams: hash and first word's index, once each."""
    gram, at = bw.grams(words, text_of, k)
    w = window - k + 1
    n = len(gram) - w + 1
    if n <= 0:
        return gram[:0], at[:0]
    best, where = gram[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = gram[j : j + n]
        better = other <= best
        best = np.where(better, other, best)
        where = np.where(better, np.arange(j, j + n), where)
    same_text = text_of[at[:n]] == text_of[at[w - 1 :]]
    chosen = np.unique(where[same_text])
    return gram[chosen], at[chosen]


def build_index(items: list[tuple[str, str]], window: int, k: int) -> Index:
    index = Index(window, k, [i for i, _ in items])
    raw = [t.encode() for _, t in items]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    words, item_of = words_of(data, offsets)
    index.prints = np.unique(winnowed(words, item_of, k, window)[0])
    index.whole, index.owner = _once(*_owned(words, item_of, window))
    sizes = np.bincount(item_of, minlength=len(items))
    for size in sorted(set(sizes[(sizes > 0) & (sizes < window)].tolist())):
        gram, own = _owned(words, item_of, size)
        short = sizes[own] == size
        index.short[size] = _once(gram[short], own[short])
    return index


def _owned(words: np.ndarray, text_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    gram, first = bw.grams(words, text_of, k)
    return gram, text_of[first]


def _once(gram: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, in order of the hashes."""
    order = np.lexsort((own, gram))
    gram, own = gram[order], own[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
    return gram[new], own[new]


def _within(keys: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Which queries are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(queries), bool)
    return keys[np.minimum(np.searchsorted(keys, queries), len(keys) - 1)] == queries


def _matches(keys: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (query, key) index pairs with equal values; ``keys`` is sorted."""
    lo, hi = np.searchsorted(keys, queries, "left"), np.searchsorted(keys, queries, "right")
    found = np.flatnonzero(hi > lo)
    counts = (hi - lo)[found]
    query = np.repeat(found, counts)
    step = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
    return query, lo[query] + step


def find(index: Index, words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words as a difference array of word intervals, and the (text, item) pairs that share a passage."""
    window, k = index.window, index.k
    marks = np.zeros(len(words) + 1, np.int64)
    texts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def found(starts: np.ndarray, gram: np.ndarray, size: int, keys: np.ndarray, own: np.ndarray) -> None:
        good = _within(keys, gram)
        np.add.at(marks, starts[good], 1)
        np.add.at(marks, starts[good] + size, -1)
        gram, text = _once(gram[good], text_of[starts[good]])
        query, key = _matches(keys, gram)
        texts.append(text[query])
        items.append(own[key])

    if len(index.prints):
        prints, at = winnowed(words, text_of, k, window)
        hit = at[_within(index.prints, prints)]
        starts = np.unique(hit[:, None] - np.arange(window - k + 1)[None])
        starts = starts[(starts >= 0) & (starts + window <= len(words))]
        starts = starts[text_of[starts] == text_of[starts + window - 1]]
        found(starts, bw.grams_at(words, starts, window), window, index.whole, index.owner)
    for size, (keys, own) in index.short.items():
        gram, first = bw.grams(words, text_of, size)
        found(first, gram, size, keys, own)
    return marks, np.concatenate(texts), np.concatenate(items)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Blocks of (item_id as text, text) of bounded size; rows without an id or text have no windows and are left out."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    held: list[tuple[str, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1]) * 2
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW_WORDS,
    k: int = GRAM_WORDS,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_words, n_hit, items (sorted ids of the items with a
    shared passage) and hit_spans ([start, end) word intervals).

    Null or wordless texts and an empty benchmark give zero counts and no items. Repeated rows are each judged.
    Items that share a passage are all listed. Other columns of either table are ignored, or those of ``keep`` are handed
    on in place of doc_id.
    """
    spark = documents.sparkSession
    base = documents.select(*keep) if keep else documents.selectExpr("cast(doc_id as long) as doc_id", "text")
    own = [c for c in base.columns if c != "text"]
    carried = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in own)
    carried += ", n_words long, spans array<struct<s:long,e:long>>, items array<string>"
    empty = "cast(array() as array<struct<s:long,e:long>>) as spans", "cast(array() as array<string>) as items"
    out = base.selectExpr(*(f"`{c}`" for c in own), "0L as n_words", *empty, "text")
    ahead: list[tuple[str, str]] = []
    scratch, step = Scratch(spark, "decontamination"), 0
    for items in chain(item_blocks(benchmark, block_bytes), [None]):
        if items is None or ahead:
            # Only a step that another one follows hands on the texts, unless they are to be kept.
            sent = spark.sparkContext.broadcast(build_index(ahead, window, k))
            texts = items is not None or "text" in (keep or [])
            out = out.mapInArrow(bw.handing_back(_mapper(sent, texts)), carried + ", text string" * texts)
            if items is not None:
                step += 1
                out = scratch.write(out, f"block{step}")
                scratch.drop(f"block{step - 1}")
        ahead = items or []
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return out.select(*(keep or ["doc_id"]), "n_words", hit.alias("n_hit"), "items", F.col("spans").alias("hit_spans"))


def _mapper(sent, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for rows, data, offsets in bw.blocks(batches):
            column = lambda name, rows=rows: rows.column(rows.schema.get_field_index(name))
            words, text_of = words_of(data, offsets)
            counts = np.bincount(text_of, minlength=rows.num_rows)
            first = np.concatenate([[0], np.cumsum(counts)])
            marks, texts, items = find(index, words, text_of)
            spans, ids = column("spans").to_pylist(), column("items").to_pylist()
            for text in np.unique(texts).tolist():
                lo, hi = first[text], first[text + 1]
                add = marks[lo:hi].copy()
                for x in spans[text]:
                    add[x["s"]] += 1
                    if x["e"] < hi - lo:
                        add[x["e"]] -= 1
                inside = np.concatenate([[0], (np.cumsum(add) > 0).astype(np.int8), [0]])
                turn = np.flatnonzero(np.diff(inside))
                spans[text] = [{"s": int(s), "e": int(e)} for s, e in zip(turn[::2], turn[1::2], strict=True)]
                ids[text] = sorted({*ids[text], *(index.ids[i] for i in np.unique(items[texts == text]).tolist())})
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            own = [c for c in rows.schema.names if c not in ("n_words", "spans", "items", "text")]
            made = [*map(column, own), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(ids, pa.list_(pa.string()))]
            names = [*own, "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays(made + [column("text")] * keep_text, names=names + ["text"] * keep_text)

    return run


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged(found).drop("items", "hit_spans")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_items, items_sha256 and contaminated to what ``decontaminate`` returns."""
    num, den = CONTAMINATED_SHARE
    return found.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", "items").cast("binary"), 256),
            "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * den >= F.col("n_words") * num),
        }
    )


#: Brute force over every window of every item, for DuckDB.
WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


def oracle(documents: str = "documents", benchmark: str = "benchmark") -> str:
    return f"""
with d as (select doc_id, {WORDS_SQL} as w from {documents}),
i as (select cast(item_id as varchar) as item, {WORDS_SQL} as w from {benchmark} where item_id is not null),
win as (select item, least(len(w), {WINDOW_WORDS}) as n,
    array_to_string(w[s : s + least(len(w), {WINDOW_WORDS}) - 1], ' ') as g
  from i, unnest(range(1, 1 + greatest(len(w) - {WINDOW_WORDS} + 1, 1))) as r(s) where len(w) > 0),
sizes as (select distinct n from win),
dw as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as g
  from (select d.doc_id, d.w, z.n, unnest(range(1, len(d.w) - z.n + 2)) as s from d, sizes z where len(d.w) >= z.n)),
hits as (select distinct dw.doc_id, dw.s, dw.n, win.item from dw join win on dw.g = win.g and dw.n = win.n),
words as (select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(s, s + n)) as p from hits) group by 1),
its as (select doc_id, count(distinct item) as n_items,
    array_to_string(list_sort(list(distinct item)), ',') as joined from hits group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(joined, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join its using (doc_id)"""


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE_SQL = {"op2_decontamination": oracle()}
