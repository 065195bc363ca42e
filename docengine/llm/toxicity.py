"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give a document's score.

Labels are of documents, so token labels are derived first. Over a bounded sample of labelled rows, words and
word prefixes that stand in many different surroundings in toxic documents and in next to none elsewhere are picked;
tokens with a picked one are labelled toxic where they stand in toxic documents. The field has two tags, weights for each token's
word, prefixes and neighbours (hashed into a fixed number of slots) and tag transitions, trained by gradient on
forward-backward expectations. A document's score is a logistic function of its largest and its summed marginal.

Scoring runs the exact forward-backward recursion over whole texts. A text is cut into rows of ``ROW`` tokens whose
2x2 transfer matrices are multiplied up, so the recursion runs over all rows of a block at once and a very long text
is no slow case. Nothing is shuffled; the model has a fixed size.
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

#: At most so many labelled documents of each class are used to fit, of at most so many code points in all.
SAMPLE_PER_CLASS = 1000
SAMPLE_CHARS = 3_000_000
SLOTS = 1 << 18
ROW = 32
#: Bytes of text scored at once: features of a token take some hundred bytes, several times over.
SCORE_BYTES = 1 << 18
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
SPAN_MARGINAL = 0.5
#: Rows of tokens to train on.
TRAIN_ROWS = 12_000
STEPS = 40


@dataclass
class Model:
    unary: np.ndarray  # by slot
    bias: float
    trans: np.ndarray  # log weights of tag pairs, 2x2
    score: np.ndarray  # intercept, weight of the largest logit, weight of log1p(sum)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of the Latin-1 block in lower case; no length changes."""
    low = bw.LOWER[data]
    if len(low) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][upper] += 0x20
    return low


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends, text of each token, and its hashes: the word, then its prefixes (0 where it is no longer)."""
    low = lowered(data)
    starts, ends, text_of = bw.spans(bw.ALNUM[low], offsets)
    keys = [bw.hashes(low, starts, ends)]
    for i, k in enumerate(PREFIXES):
        h = bw.hashes(low, starts, np.minimum(starts + k, ends)) + np.uint64(i + 1)
        keys.append(np.where(ends - starts > k, h, np.uint64(0)))
    return starts, ends, text_of, np.stack(keys, 1) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.uint64)


def slots(keys: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Feature slots of each token: own keys, and the words before and after it. Slot 0 is no feature."""
    n = len(keys)
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if n > 1:
        same = text_of[1:] == text_of[:-1]
        before[1:] = np.where(same, keys[:-1, 0] * np.uint64(3), 0)
        after[:-1] = np.where(same, keys[1:, 0] * np.uint64(5), 0)
    every = [*keys.T, before, after]
    out = np.zeros((n, len(every)), np.int32)
    for i, c in enumerate(every):
        out[:, i] = np.where(c == 0, 0, 1 + c % np.uint64(SLOTS - 1))
    return out


def rows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ROW tokens: for texts of so many tokens, the row and column of each token, and the text of each row."""
    per = -(-counts // ROW)
    first_row = np.concatenate([[0], np.cumsum(per)])
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first_row[:-1], counts) + within // ROW, within % ROW, np.repeat(np.arange(len(counts)), per)


def marginals(u: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of texts with unary scores ``u``, by forward-backward over whole texts."""
    if not len(u):
        return np.zeros(0)
    row, col, text = rows_of(counts)
    n_rows = len(text)
    weight = np.ones((n_rows, ROW))
    real = np.zeros((n_rows, ROW), bool)
    weight[row, col], real[row, col] = np.exp(np.clip(u, -30, 30)), True
    a = np.exp(trans)

    # Each row's transfer matrix, scaled: from the tag before the row to its last tag.
    m = np.broadcast_to(np.eye(2), (n_rows, 2, 2)).copy()
    for t in range(ROW):
        live = real[:, t]
        step = m @ a
        step[:, :, 1] *= weight[:, t, None]
        step /= step.max((1, 2), keepdims=True)
        m = np.where(live[:, None, None], step, m)

    # Messages into each row from the left and the right; the k-th row of all texts at once.
    per = np.bincount(text, minlength=len(counts))
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    left, right = np.ones((n_rows, 2)), np.ones((n_rows, 2))
    order = np.argsort(-per, kind="stable")
    many = np.searchsorted(-per[order], -np.arange(1, per.max() + 1), "right")
    for k in range(1, per.max()):
        at = first[order[: many[k]]] + k
        x = np.einsum("ni,nij->nj", left[at - 1], m[at - 1])
        left[at] = x / x.max(1, keepdims=True)
        back = (first + per - 1)[order[: many[k]]] - k
        y = np.einsum("nij,nj->ni", m[back + 1], right[back + 1])
        right[back] = y / y.max(1, keepdims=True)

    alpha = np.empty((ROW, n_rows, 2))
    x = left
    for t in range(ROW):
        step = x @ a
        step[:, 1] *= weight[:, t]
        x = np.where(real[:, t, None], step / step.max(1, keepdims=True), x)
        alpha[t] = x
    p = np.empty((n_rows, ROW))
    y = right
    for t in range(ROW - 1, -1, -1):
        both = alpha[t] * y
        p[:, t] = both[:, 1] / both.sum(1)
        step = y.copy()
        step[:, 1] *= weight[:, t]
        step = step @ a.T
        y = np.where(real[:, t, None], step / step.max(1, keepdims=True), y)
    return p[row, col]


def seeds(keys: np.ndarray, text_of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Keys that mark toxic documents. A key's support is the number of its different surroundings (key, word before,
    word after), so that copies of a passage count once. It is a seed if it is at least 50 times as frequent among
    toxic documents, in three of them at least, and its support would not come by chance for any of so many keys."""
    n = len(keys)
    around = np.zeros(n, np.uint64)
    around[1:] = keys[:-1, 0]
    around[:-1] += keys[1:, 0] * np.uint64(3)
    bad = toxic[text_of]
    share = min(max(float(bad.mean()) if n else 0.0, 1e-3), 0.9)
    found, distinct = [], 0
    for kind in range(keys.shape[1]):  # one kind of key at a time, for less memory
        real = np.flatnonzero(keys[:, kind])
        key, group = np.unique(keys[real, kind], return_inverse=True)
        distinct += len(key)
        place, docs, wrong = bw.mixed(keys[real, kind] + around[real]), text_of[real], bad[real]

        def support(of: np.ndarray, what: np.ndarray, group: np.ndarray = group, size: int = len(key)) -> np.ndarray:
            pair = bw.mixed(group[of].astype(np.uint64)) ^ what[of].astype(np.uint64)
            _, first = np.unique(pair, return_index=True)
            return np.bincount(group[of][first], minlength=size)

        k_toxic, k_other = support(wrong, place), support(~wrong, place)
        pure = (k_other + 0.1) * share * 50 <= k_toxic * (1 - share)
        some = pure & (support(wrong, docs) >= 3)
        found.append((key[some], k_toxic[some]))
    strong = lambda k: k * -np.log(share) >= np.log(max(distinct, 1)) + 3
    return np.concatenate([key[strong(k)] for key, k in found])


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fit on labelled texts. Without both classes, every score is the share of toxic labels (or 0)."""
    kept: dict[str, int] = {}
    for text, label in zip(texts, labels, strict=True):  # copies count once
        kept[text] = max(label, kept.get(text, 0))
    toxic = np.array([x > 0 for x in kept.values()], bool)
    if not toxic.any() or toxic.all():
        share = min(max(float(toxic.mean()) if len(toxic) else 0.0, 1e-3), 1 - 1e-3)
        return Model(np.zeros(SLOTS, np.float32), 0.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0]))
    raw = [t.encode() for t in kept]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    _, _, text_of, keys = tokens(data, offsets)
    marks = np.isin(keys, seeds(keys, text_of, toxic)).any(1) & toxic[text_of]
    feats = slots(keys, text_of)
    counts = np.bincount(text_of, minlength=len(raw))
    row, col, row_text = rows_of(counts)

    # All rows with a toxic token, and others evenly up to the bound; unmarked rows of toxic documents are left out.
    has = np.bincount(row[marks], minlength=len(row_text)) > 0
    rest = np.flatnonzero(~has & ~toxic[row_text])
    some = np.flatnonzero(has)
    some = some[:: max(1, -(-len(some) // (TRAIN_ROWS // 2)))]
    use = np.sort(np.concatenate([some, rest[:: max(1, -(-len(rest) // (TRAIN_ROWS - len(some))))]]))
    place = np.full(len(row_text), -1)
    place[use] = np.arange(len(use))
    mine = place[row] >= 0
    r, c, f, y = place[row[mine]], col[mine], feats[mine], marks[mine]
    real, gold = np.zeros((len(use), ROW), bool), np.zeros((len(use), ROW))
    real[r, c], gold[r, c] = True, y
    pairs = real[:, 1:] & real[:, :-1]
    seen = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)], float)

    w, bias, trans = np.zeros(SLOTS), -2.0, np.zeros((2, 2))
    size = max(len(use), 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros(5), np.zeros(5)]
    for step in range(1, STEPS + 1):
        u = np.zeros((len(use), ROW))
        u[r, c] = w[f].sum(1) + bias
        p, xi = _expectations(u, real, trans)
        miss = (p[r, c] - y) / size
        gw = np.bincount(f.ravel(), np.repeat(miss, f.shape[1]), SLOTS) + 1e-6 * w
        gw[0] = 0.0
        gs = np.append((xi - seen).ravel() / size + 1e-4 * trans.ravel(), miss.sum())
        rate = 0.5 / (1 + step / 20)
        for k, g in ((0, gw), (2, gs)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
        move = [rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-7) for k in (0, 2)]
        w -= move[0]
        trans, bias = trans - move[1][:4].reshape(2, 2), bias - move[1][4]
    model = Model(w.astype(np.float32), float(bias), trans, np.zeros(3))
    x = np.column_stack([np.ones(len(raw)), aggregates(marginals(model.unary[feats].sum(1) + model.bias, trans, counts), counts)])
    model.score = _logistic(x, toxic.astype(float))
    return model


def _expectations(u: np.ndarray, real: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected tag-pair counts of rows taken each for itself."""
    a, weight = np.exp(trans), np.exp(np.clip(u, -30, 30))
    n, length = u.shape
    alpha, beta = np.ones((length, n, 2)), np.ones((length, n, 2))
    for t in range(length):
        x = alpha[t - 1] @ a if t else np.ones((n, 2))
        x[:, 1] *= weight[:, t]
        x /= x.sum(1, keepdims=True)
        alpha[t] = x if not t else np.where(real[:, t, None], x, alpha[t - 1])
    for t in range(length - 2, -1, -1):
        x = beta[t + 1].copy()
        x[:, 1] *= weight[:, t + 1]
        x = x @ a.T
        beta[t] = np.where(real[:, t + 1, None], x / x.sum(1, keepdims=True), beta[t + 1])
    both = alpha * beta
    p = (both[:, :, 1] / both.sum(2)).T
    xi = np.zeros((2, 2))
    for t in range(1, length):
        x = beta[t].copy()
        x[:, 1] *= weight[:, t]
        pair = alpha[t - 1][:, :, None] * a * x[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        xi += pair[real[:, t]].sum(0)
    return p, xi


def aggregates(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Largest logit, clipped, and log1p of the sum of each text's marginals; texts without tokens get the least."""
    out = np.column_stack([np.full(len(counts), -8.0), np.zeros(len(counts))])
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        q = np.clip(p, 1e-9, 1 - 1e-9)
        out[full, 0] = np.clip(np.maximum.reduceat(np.log(q / (1 - q)), at), -8, 8)
        out[full, 1] = np.log1p(np.add.reduceat(p, at))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps; both classes weigh the same."""
    w = np.zeros(x.shape[1])
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (share * (p - y)) + ridge * w)
    return w


def _scorer(sent, carried: tuple[str, ...] = ("doc_id",)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for rows, data, offsets in bw.blocks(batches, limit=SCORE_BYTES):
            starts, ends, text_of, keys = tokens(data, offsets)
            counts = np.bincount(text_of, minlength=rows.num_rows)
            p = marginals(model.unary[slots(keys, text_of)].sum(1) + model.bias, model.trans, counts)
            x = np.column_stack([np.ones(rows.num_rows), aggregates(p, counts)])
            score = 1 / (1 + np.exp(-np.clip(x @ model.score, -30, 30)))
            spans: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            hot = np.flatnonzero(p >= SPAN_MARGINAL)
            if len(hot):
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(text_of[hot]) > 0)) + 1
                for part in np.split(hot, cut):
                    text = text_of[part[0]]
                    base = points[offsets[text]]
                    spans[text].append({"start": int(points[starts[part[0]]] - base), "end": int(points[ends[part[-1]]] - base)})
            made = [*(rows.column(rows.schema.get_field_index(c)) for c in carried), pa.array(score), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(made, names=[*carried, "score", "spans"])

    return run


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def sample(documents: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, chars: int) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of each class, in order of a hash of doc_id, of at most ``chars`` code points in
    all: a text that the rest of the bound does not hold is passed over, texts of any length within it are not."""
    known = labelled(labels, label, train)
    sizes = documents.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))
    sized = known.join(sizes, "doc_id")
    chosen = []
    for y in (0, 1):
        left = chars
        for row in sized.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            if row["n"] <= left:
                left -= row["n"]
                chosen.append((row["doc_id"], y))
    if not chosen:
        return []
    picked = documents.sparkSession.createDataFrame(chosen, "doc_id long, y int")
    # The picked rows are at most 2 * per_class.
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").collect()
    return [(r["text"], int(r["y"])) for r in rows]


def labelled(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """doc_id and label y (0 or 1) of the rows to learn from; of labels that differ the larger one."""
    return labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("y"))


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, score, spans (start and end in code points of the runs of
    tokens whose marginal is at least SPAN_MARGINAL). Null and empty texts get the score of a text without tokens.
    Other columns are ignored, or those of ``keep`` are handed on beside score and spans; repeated rows score alike."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    base = documents.select(*keep) if keep else documents.selectExpr("cast(doc_id as long) as doc_id", "text")
    carried = tuple(keep or ["doc_id"])
    fields = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in carried)
    return base.mapInArrow(bw.handing_back(_scorer(sent, carried)), fields + ", score double, spans array<struct<start:long,end:long>>")


def trained(documents: DataFrame, labels: DataFrame, train: Column) -> Model:
    rows = sample(documents, labels, "toxic", train, SAMPLE_PER_CLASS, SAMPLE_CHARS)
    return fit([t for t, _ in rows], [y for _, y in rows])


def toxic_scores(documents: DataFrame, labels: DataFrame, labelled_texts: DataFrame | None = None) -> DataFrame:
    """Scores of ``documents`` by a model of the labelled rows outside the held-out fold. Without any such rows every score
    is the prior; an empty table gives no rows."""
    train = fold(F.col("doc_id"), 3) != 1
    scored = score(documents, trained(labelled_texts if labelled_texts is not None else documents, labels, train))
    return scored.withColumns({"held_out": fold(F.col("doc_id"), 3) == 1, "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents`` by a model of the labels outside the held-out fold."""
    out = toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    text = F.expr("array_join(transform(spans, x -> concat(x.start, ':', x.end)), ',')")
    return out.select("doc_id", "held_out", "score", "predicted", text.alias("spans"))


QUERIES = {"op7_toxicity": op7_toxicity}
#: A trained model is not SQL; tested by held-out accuracy and against a recursion over all tag sequences.
ORACLE_SQL: dict[str, str] = {}
