"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text gives a short vector of statistics, transformed so that each is roughly normal (logarithms of sizes, square
roots of shares). Each class has a mean and a covariance, shrunk towards the pooled covariance and towards a multiple of
the identity, and the Cholesky factor of each is computed once. A score is the posterior of class 1: the logistic of the
difference of the classes' log densities, from Mahalanobis distances by triangular factors.

Scoring is one pass with vectorised statistics; nothing is shuffled and the model is a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bytewords as bw
from docengine.llm.spill import table
from docengine.llm.toxicity import fold, labelled, sample

#: At most so many labelled documents of each class give means and covariances, of at most so many code points in all.
SAMPLE_PER_CLASS = 3000
SAMPLE_CHARS = 9_000_000
THRESHOLD = 0.3
#: Shares of the pooled covariance and of the identity in each class's covariance.
TO_POOLED, TO_IDENTITY = 0.2, 0.05
NAMES = ("words", "word_length", "distinct", "repeats", "top_word", "symbols", "bars", "digits", "capitals", "shouts", "lines", "line_copies", "stops")

_BYTE = np.arange(256)
_IS = {
    "symbols": np.isin(_BYTE, [ord(c) for c in "#$%&*@^~`=+<>{}[]\\_/"]),
    "bars": _BYTE == ord("|"),
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "capitals": (_BYTE >= 65) & (_BYTE <= 90),
    "shouts": _BYTE == ord("!"),
    "stops": np.isin(_BYTE, [ord(c) for c in ".,;:?"]),
}
_NOT_LINE_END = _BYTE != 10


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text, columns as in NAMES. A text without words has zeros."""
    n = len(offsets) - 1
    low = bw.LOWER[data]
    starts, ends, text_of = bw.spans(bw.SOLID[low], offsets)
    words = np.bincount(text_of, minlength=n).astype(float)
    some = np.maximum(words, 1.0)
    size = np.maximum(np.diff(offsets).astype(float), 1.0)

    def total(member: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(member[data])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    h = bw.hashes(low, starts, ends)
    distinct, top = _distinct(h, text_of, n)
    same = np.zeros(n)
    if len(h) > 1:
        again = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
        same = np.bincount(text_of[1:][again], minlength=n).astype(float)
    ls, le, line_of = bw.spans(_NOT_LINE_END[data], offsets)
    lines = np.bincount(line_of, minlength=n).astype(float)
    line_kinds, _ = _distinct(bw.hashes(data, ls, le), line_of, n)
    share = {k: np.sqrt(total(_IS[k]) / size) for k in _IS}
    letters = np.bincount(text_of, (ends - starts).astype(float), n)
    x = {
        "words": np.log1p(words),
        "word_length": np.log1p(letters / some),
        "distinct": distinct / some * np.log1p(words),
        "repeats": np.sqrt(same / some),
        "top_word": np.sqrt(top / some),
        "lines": np.log1p(lines / some * 20),
        "line_copies": np.sqrt(1 - line_kinds / np.maximum(lines, 1)),
    } | share
    out = np.column_stack([x[k] for k in NAMES])
    out[words == 0] = 0.0
    return out


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner, the number of different hashes and the count of its most frequent one."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, owner[at], counts)
    return np.bincount(owner[at], minlength=n).astype(float), top


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # 2 x d
    inverse: np.ndarray  # 2 x d x d, inverses of the Cholesky factors
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        density = []
        for c in (0, 1):
            y = (z - self.means[c]) @ self.inverse[c].T
            density.append(self.log_prior[c] - 0.5 * self.log_det[c] - 0.5 * (y * y).sum(1))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, prior: tuple[int, int] | None = None) -> Model:
    """Fit on statistics and labels; ``prior`` is how many rows of each class there are in all, by default those given. A
    class with no rows leaves the prior alone to decide."""
    d = x.shape[1] if len(x) else len(NAMES)
    y = np.zeros(0) if y is None else y
    known = np.array(prior if prior is not None else [(y == 0).sum(), (y == 1).sum()], float)
    share = np.clip(known / known.sum(), 1e-3, 1 - 1e-3) if known.sum() else np.array([0.5, 0.5])
    if not len(x) or y.min() == y.max():
        return Model(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), np.log(share))
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - center) / scale
    means = np.stack([z[y == c].mean(0) for c in (0, 1)])
    spread = [(z[y == c] - means[c]).T @ (z[y == c] - means[c]) for c in (0, 1)]
    counts = np.array([(y == 0).sum(), (y == 1).sum()])
    pooled = (spread[0] + spread[1]) / max(len(z) - 2, 1)
    inverse, log_det = [], []
    for c in (0, 1):
        own = spread[c] / max(counts[c] - 1, 1)
        cov = (1 - TO_POOLED) * own + TO_POOLED * pooled
        cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * np.eye(d) * np.trace(cov) / d
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Model(center, scale, means, np.stack(inverse), np.array(log_det), np.log(share))


def statistics_of(texts: list[str]) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = [statistics(data, offsets) for _, data, offsets in bw.blocks([batch])]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for rows, data, offsets in bw.blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(statistics(data, offsets)))], names=["doc_id", "score"])

    return run


def trained(documents: DataFrame, labels: DataFrame, train: Column) -> Model:
    """Means and covariances come from a bounded sample, the classes' prior from all labels to learn from."""
    counts = {r["y"]: r["n"] for r in labelled(labels, "quality", train).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sample(documents, labels, "quality", train, SAMPLE_PER_CLASS, SAMPLE_CHARS)
    return fit(statistics_of([t for t, _ in rows]), np.array([y for _, y in rows]), (counts.get(0, 0), counts.get(1, 0)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, score. Null, empty and wordless texts score as a text whose
    statistics are all zero. Other columns are ignored; repeated rows score alike; an empty table gives no rows."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return documents.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_scorer(sent), "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents`` by a model of the labels outside the held-out fold."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents, trained(documents, labels, fold(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
#: A trained model is not SQL; tested by held-out accuracy and against plain formulas.
ORACLE_SQL: dict[str, str] = {}
