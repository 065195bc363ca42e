"""Each stage of the pipeline against what it must keep."""

import itertools
import re
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from docengine.llm import secret_scan, spill, toxicity


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def firsts(texts):
    """The smallest id of each group of near copies, from all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


def clean(texts, items):
    """The ids of texts that share too few words with windows of the items, window by window."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {tuple(w[j : j + 13]) for w in map(split, items) if w for j in range(max(1, len(w) - 12))}
    sizes, kept = {len(w) for w in windows}, set()
    for i, t in texts.items():
        w, hit = split(t), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
        if not hit or 20 * len(hit) < len(w):
            kept.add(i)
    return kept


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secret_scan", "source_mix"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "source_mix":
            assert out.columns == names
        if name == "toxicity":
            model = toxicity.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"), toxicity.fold(F.col("doc_id"), 3) != 1)
            kept = {r["doc_id"] for r in toxicity.score(docs, model).where(f"score < {toxicity.THRESHOLD}").collect()}
            assert set(after) == kept
        if name == "ngram_jaccard":
            assert set(after) == firsts({i: r["text"] for i, r in before.items()})
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == clean({i: r["text"] for i, r in before.items()}, items)
            assert len(after) > 0.8 * len(before)
        if name == "secret_scan":
            assert set(after) == set(before)
            rank = secret_scan.ranked(secret_scan.common_words(docs))
            for i, r in after.items():
                assert r["text"] == secret_scan.mask(before[i]["text"], rank) and r["n_chars"] == len(r["text"])
                assert not secret_scan.base_spans(r["text"])
        if name == "source_mix":
            assert set(after) == set(before)
        docs = docs.join(out.select("doc_id"), "doc_id", "left_semi") if name == "source_mix" else corpus_pipeline.written(out, "test")
    assert corpus_pipeline.run(spark, sf).count() == len(after)


def test_stages_with_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, "password=abcdefgh99", "en", "s", 19), (3, "password=abcdefgh99", "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "odd")
    assert docs.count() == 4
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, sf), "empty")
    assert empty.count() == 0


def test_rows_left_out_by_id_stay_out_of_python(spark):
    """What is not among ids, over ids of any kind, without a Python worker for the rows' texts."""
    own = [None, 0, -1, 1, 63, 64, 8191, 8192, 2**62, -(2**63), 2**63 - 1, *range(100, 3000)]
    gone = {0, -1, 64, 2**62, -(2**63), *range(101, 3000, 2)}
    docs = spark.createDataFrame([(i, f"t{i}") for i in own], "doc_id long, text string")
    ids = spark.createDataFrame([(None,), *((i,) for i in sorted(gone))], "doc_id long")
    for found, away in ((ids, gone), (ids.where("doc_id is null"), set())):
        kept = spill.not_among(docs, found)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(((i, f"t{i}") for i in own if i not in away), key=repr)
        assert "ArrowPython" not in (plan := kept._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" not in plan
    held = spill.IdFilter(ids)
    hit, rest = ({r["doc_id"] for r in held.rows(docs, "doc_id", hit=h).collect()} for h in (True, False))
    assert gone <= hit and None in rest and hit | rest == set(own) and not hit & rest and len(rest) > len(own) / 3


def test_masking_takes_memory_for_small_blocks_and_hands_it_back():
    """In a worker of its own, as it stays for the next stage; null and empty texts stand among the others."""
    code = """
import re
import subprocess
import sys
from pathlib import Path
import pyarrow as pa
from docengine.llm import bytewords as bw
from docengine.llm import secret_scan

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

def batches():
    for k in range(3):
        texts = [None if i % 50 == 1 else "" if i % 50 == 2 else f"{i} token=abcdefgh{i} " + "é plain words " * 250 for i in range(8000)]
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(8000)), "text": texts, "n_chars": [k] * 8000})

def run(most):
    rows = 0
    for out in bw.handing_back(lambda held: secret_scan._mask(held, secret_scan.RANK))(batches()):
        assert out.column("text").nbytes < most, out.column("text").nbytes
        for i, t in zip(*(out.column(c).to_pylist() for c in ("doc_id", "text"))):
            want = None if i % 50 == 1 else "" if i % 50 == 2 else f"{i} [ASSIGN] " + "é plain words " * 250
            assert t == want
            rows += 1
    return rows

before = held()
assert run(2 * 2**20) == 24000
assert held() - before < 40, held() - before
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
