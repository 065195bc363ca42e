"""Token counts without token ids.

A text's tokens are the pieces of its pre-tokens, and equal pre-tokens have equal pieces. So (1) the distinct
pre-tokens of the whole corpus are gathered with their frequencies, (2) each one's pieces are counted once, by the
tokenizer's own model, (3) each text becomes a table of pre-token frequencies, which is joined to the piece counts and
summed. The most frequent pre-tokens, at most HEAD_TOKENS of them however large the corpus, are looked up in a broadcast
table of fixed size; the others, rare by construction, go through a join on the pre-token, so no join key is hot.

Pre-tokens are found over arrays of code points, following the tokenizer's normaliser and pattern: NFC, lower case
character by character, then contractions, runs of letters, single digits and runs of other signs. Texts that need more
than a table by character (contractions, combining marks, special strings) take the regular-expression way. Special
strings inside a text are one token each, as is the library's default.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bytewords as bw
from docengine.llm.spill import table, written

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
#: Most pre-tokens whose piece counts are broadcast (16 bytes each).
HEAD_TOKENS = 1 << 18
#: Distinct pre-tokens that a task holds before it hands them on.
FLUSH_TOKENS = 150_000
#: Bytes of text handled at once: arrays over code points take some fifty times as much.
BLOCK_BYTES = 1 << 19

# The tokenizer's special strings and its pattern.
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
# What a file must say of itself for this to hold.
SPECIAL_STRINGS = {"<|startoftext|>", "<|endoftext|>"}
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
AFTER_APOSTROPHE = "strvmld"
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3


@cache
def check_file(path: str) -> None:
    """Refuses a tokenizer file whose special strings, normaliser or pre-tokens are not those that are found here."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {t["content"] for t in said["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])}
    split, levels = ((said["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])[:2]
    same = (
        special == SPECIAL_STRINGS == {t["content"] for t in said["added_tokens"]}
        and (said["normalizer"] or {}).get("normalizers") == NORMALIZER
        and split.get("pattern") == {"Regex": PRE_TOKENIZER}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and (levels.get("type"), levels.get("add_prefix_space"), levels.get("use_regex")) == ("ByteLevel", False, False)
    )
    if not same:
        raise ValueError(f"{path} divides texts otherwise than this operator does")


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class once lower-cased, lower case, whether a text with it takes the slow way, a random value."""
    size = sys.maxunicode + 1
    kind = np.zeros(size, np.uint8)
    whole = np.arange(size, dtype=np.uint32)
    whole[0xD800:0xE000] = ord("!")
    every = whole.tobytes().decode("utf-32-le")
    for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = k
    lower = np.arange(size, dtype=np.uint32)
    slow = np.zeros(size, bool)
    slow[0x30000:] = True
    for c in range(0x30000):
        ch = every[c]
        low = ch.lower()
        if len(low) == 1:
            lower[c] = ord(low) if not 0xD800 <= c < 0xE000 else c
        slow[c] = len(low) != 1 or (c > 127 and (unicodedata.combining(ch) != 0 or not unicodedata.is_normalized("NFC", ch)))
    slow[0x1161:0x1176] = slow[0x11A8:0x11C3] = True  # parts of syllables that NFC may join
    value = np.random.default_rng(20240608).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    return kind[lower], lower, slow, value


def _hashed(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value = tables()[3]
    up, down = bw.powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(value[points] * up[: len(points)], out=sums[1:])
    return bw.mixed((sums[ends] - sums[starts]) * down[starts])


def hashes_of(tokens: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in tokens]).astype(np.int64)
    return _hashed(points, np.concatenate([[0], ends])[:-1].astype(np.int64), ends)


def slow_pretokens(text: str) -> tuple[list[str], int]:
    """Pre-tokens of a text in order, and the number of special strings in it."""
    parts = SPECIAL.split(text)
    found: list[str] = []
    for part in parts:
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        found += PATTERN.findall(part)
    return found, len(parts) - 1


class Block:
    """The pre-tokens of a block of texts: per (text, pre-token) the hash, the count and where the pre-token stands."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind, lower, slow, _ = tables()
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        low = lower[points]
        k = kind[points]
        n = len(offsets) - 1
        odd = slow[points]
        if len(points) > 1:
            tail = np.isin(low[1:], np.frombuffer(AFTER_APOSTROPHE.encode("utf-32-le"), np.uint32))
            odd[:-1] |= (points[:-1] == ord("'")) & tail
            odd[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))
        sums = np.concatenate([[0], np.cumsum(odd)])
        self.slow = np.flatnonzero(sums[at[1:]] > sums[at[:-1]])
        first = k != SPACE
        if len(k) > 1:
            first[1:] &= (k[1:] != k[:-1]) | (k[1:] == DIGIT)
            edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(k))]
            first[edge] = k[edge] != SPACE
        starts = np.flatnonzero(first)
        # A token ends where the next begins or at the first space or text end after it.
        stop = np.zeros(len(k) + 1, bool)
        stop[:-1] = first | (k == SPACE)
        stop[at] = True
        stops = np.flatnonzero(stop)
        ends = stops[np.searchsorted(stops, starts, "right")]
        owner = np.searchsorted(at, starts, "right") - 1
        if len(self.slow):
            fast = ~np.isin(owner, self.slow)
            starts, ends, owner = starts[fast], ends[fast], owner[fast]
        h = _hashed(low, starts, ends)
        pair = bw.mixed(h ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, where, counts = np.unique(pair, return_index=True, return_counts=True)
        self.owner, self.hash, self.count = owner[where], h[where], counts
        self._starts, self._ends, self._low = starts[where], ends[where], low
        self.special = np.zeros(n, np.int64)
        self._own: list[str] = []
        if len(self.slow):
            owners, counts = [], []
            for i in self.slow.tolist():
                tokens, self.special[i] = slow_pretokens(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                for t, c in Counter(tokens).items():
                    self._own.append(t)
                    owners.append(i)
                    counts.append(c)
            self.owner = np.concatenate([self.owner, np.array(owners, np.int64)])
            self.count = np.concatenate([self.count, np.array(counts, np.int64)])
            self.hash = np.concatenate([self.hash, hashes_of(self._own)]) if self._own else self.hash

    def strings(self, index: np.ndarray) -> list[str]:
        """The pre-tokens at ``index``."""
        text = self._low.tobytes().decode("utf-32-le")
        n = len(self._starts)
        inside = index[index < n]
        s, e = self._starts[inside].tolist(), self._ends[inside].tolist()
        return [text[a:b] for a, b in zip(s, e, strict=True)] + [self._own[i] for i in (index[index >= n] - n).tolist()]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def out() -> pa.RecordBatch:
        rows = list(held.values())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["token", "n"])

    for _, data, offsets in bw.blocks(batches, limit=BLOCK_BYTES):
        block = Block(data, offsets)
        keys, where, back = np.unique(block.hash, return_index=True, return_inverse=True)
        counts = np.bincount(back, minlength=len(keys))
        order = np.argsort(where, kind="stable")  # strings come in order of index
        for key, c, token in zip(keys[order].tolist(), counts[order].tolist(), block.strings(where[order]), strict=True):
            if key in held:
                held[key][1] += c
            else:
                held[key] = [token, c]
        if len(held) > FLUSH_TOKENS:
            yield out()
            held.clear()
    yield out()


@cache
def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def _model(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_count(path: str, token: str) -> int:
    signs = byte_signs()
    return len(_model(path).model.tokenize(token if token.isascii() and token.isalnum() else "".join(signs[b] for b in token.encode())))


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [piece_count(path, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["token", "n", "pieces"])

    return run


def _frequencies(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pieces = sent.value
        for rows, data, offsets in bw.blocks(batches, limit=BLOCK_BYTES):
            n = rows.num_rows
            block = Block(data, offsets)
            at = np.minimum(np.searchsorted(keys, block.hash), max(len(keys) - 1, 0))
            known = keys[at] == block.hash if len(keys) else np.zeros(len(block.hash), bool)
            total = block.special + np.bincount(block.owner[known], block.count[known] * pieces[at[known]], n).astype(np.int64)
            rest = np.flatnonzero(~known)
            uid = rows.column(2).to_numpy()
            tokens = block.strings(rest)
            none = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(uid, pa.int64()), pa.array(uid[block.owner[rest]], pa.int64())]),
                    pa.concat_arrays([rows.column(0).cast(pa.int64()), none]),
                    pa.concat_arrays([pa.array(np.diff(offsets), pa.int64()), none]),
                    pa.array([f" {i}" for i in uid.tolist()] + tokens, pa.string()),
                    pa.concat_arrays([pa.array(total, pa.int64()), pa.array(block.count[rest], pa.int64())]),
                ],
                names=["uid", "doc_id", "n_bytes", "token", "n"],
            )

    return run


def piece_table(texts: DataFrame, path: str) -> DataFrame:
    """token, n, pieces of each distinct pre-token of the column ``text``: n is the number of texts' entries it has."""
    distinct = texts.select("text").mapInArrow(_distinct, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return written(distinct.mapInArrow(_pieces(path), "token string, n long, pieces long"), "token-pieces")


def head(pieces: DataFrame, most: int = HEAD_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and piece counts of the most frequent pre-tokens, at most ``most``: those above a frequency that a
    histogram of logarithms gives."""
    steps = pieces.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("c")).collect()
    left, least = most, None
    for step, c in sorted(((r["step"], r["c"]) for r in steps), reverse=True):
        if c > left:
            break
        left, least = left - c, step
    rows = pieces.where(F.floor(F.log2("n") * 8) >= least).select("token", "pieces").collect() if least is not None else []
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = hashes_of([r["token"] for r in rows]), np.array([r["pieces"] for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def token_counts(documents: DataFrame, path: str, *, max_tokens: int = MAX_TOKENS, head_tokens: int = HEAD_TOKENS) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizer file at ``path`` without begin, end or added tokens, over whole texts; a null
    text is empty and has none. A file that divides texts into other pre-tokens is refused. Repeated rows are counted each;
    other columns are ignored; an empty table gives no rows.
    """
    check_file(path)
    texts = documents.selectExpr("cast(doc_id as long) as doc_id", "text")
    pieces = piece_table(texts, path)
    sent = documents.sparkSession.sparkContext.broadcast(head(pieces, head_tokens))
    marked = texts.withColumn("uid", F.monotonically_increasing_id())
    rows = marked.mapInArrow(_frequencies(sent), "uid long, doc_id long, n_bytes long, token string, n long")
    # A text's own row has a token that no pre-token equals, as none holds a space, and its known pieces as n.
    counted = rows.join(pieces.select("token", "pieces"), "token", "left")
    total = F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).cast("long")
    out = counted.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all of ``documents`` by the vocabulary file TOKENIZER."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op1_token_counts": op1_token_counts}
#: A vocabulary's merges are not SQL; tested against the library itself.
ORACLE_SQL: dict[str, str] = {}
