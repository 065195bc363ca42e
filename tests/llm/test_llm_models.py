"""Brute force and held-out checks of what SQL cannot express."""

import itertools
import math
import re

import numpy as np
import pytest

from docengine.llm import bytewords as bw
from docengine.llm import license_scan, quality, secret_scan, spotsigs, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_byte_words_are_regex_words():
    texts = ["", "Ab9 c-d", "é x", "x", "ÀB", " a  b ", "日本 語"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0] + [len(x) for x in raw])
    low = bw.LOWER[data]
    s, e, owner = bw.spans(bw.ALNUM[low], offsets)
    got = [(int(o), low[a:b].tobytes().decode()) for a, b, o in zip(s, e, owner, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(ascii_lower(t))]
    h = bw.hashes(low, s, e)
    assert len({w for _, w in got}) == len(set(h.tolist())) and h[2] == h[2]


def test_guess_cost_is_the_cheapest_segmentation():
    def brute(v):
        parts, best = secret_scan._parts(v), math.inf
        n = len(v)
        for cuts in itertools.product((0, 1), repeat=n - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
            total = 0.0
            for a, b in itertools.pairwise(edges):
                known = [c for j, c in parts[a] if j == b]
                total += secret_scan.PER_PART + min([*known, (b - a) * secret_scan.PER_CHAR])
            best = min(best, total)
        return best

    for v in ("password1", "aaaa1999", "qwerty12", "x9dragonx", "abcabcabc", "20240131zz", "p4ssw0rd", "z"):
        assert secret_scan.guess_cost(v) == pytest.approx(brute(v))
    assert secret_scan.guess_cost("") == 0
    assert secret_scan.guess_cost("changeme123") < secret_scan.MIN_GUESSES_LOG10 < secret_scan.guess_cost("b7db7aa4a5fcc78305")


def test_words_after_a_credential_word_are_no_secrets():
    prose = ["configuration", "identification", "relationship", "references", "understanding", "thedefaultvalue", "changeme123", "administrator"]
    for v in prose:
        assert secret_scan.guess_cost(v) < secret_scan.MIN_GUESSES_LOG10, v
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    for v in prose:
        assert secret_scan.guess_cost("".join(rng.choice(letters, max(len(v), 14)))) >= secret_scan.MIN_GUESSES_LOG10
    assert secret_scan.guess_cost("anblewhsttible", secret_scan.ranked(["anblewh", "sttible"])) < 5 < 10 < secret_scan.guess_cost("anblewhsttible")


def test_guess_cost_is_linear():
    import time

    for unit in ("a", "qw", "abc", "ab12"):
        value = unit * (200_000 // len(unit))
        began = time.time()
        assert secret_scan.guess_cost(value) < 20
        assert time.time() - began < 30


def test_words_of_the_corpus(spark):
    rows = [("Alpha beta alpha",), ("beta GAMMA",), ("beta x yz " + "q" * 40,), (None,), ("",), ("gamma9gamma",)]
    frame = spark.createDataFrame(rows, "text string")
    assert secret_scan.common_words(frame) == ["beta", "gamma"] and secret_scan.common_words(frame, 1) == ["beta"]
    assert secret_scan.common_words(frame.limit(0)) == []


def test_base_columns_by_brute_force(spark, sf):
    """The base patterns character by character, without regular expressions, over all texts."""
    import hashlib

    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")

    def assign_at(t, i):
        for w in words:
            if ascii_lower(t[i : i + len(w)]) != w:
                continue
            j = i + len(w)
            j += j < len(t) and t[j] in "\"'"
            # An optional quote may be left out again only where no separator follows it.
            while j < len(t) and t[j] == " ":
                j += 1
            if j >= len(t) or t[j] not in ":=":
                continue
            j += 1
            while j < len(t) and t[j] == " ":
                j += 1
            j += j < len(t) and t[j] in "\"'"
            e = j
            while e < len(t) and t[e] in value:
                e += 1
            if e > j:
                return e, e - j
        return None

    def runs(t, start, member):
        i = 0
        while i < len(t):
            if t.startswith(start, i):
                e = i + len(start)
                while e < len(t) and t[e] in member:
                    e += 1
                if e > i + len(start):
                    yield i, e
                    i = e
                    continue
            i += 1

    some = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = {r["doc_id"]: r for r in secret_scan.scan(some).collect()}
    upper, hexes = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")
    seen = 0
    for r in some.collect():
        t, found, i = r["text"] or "", [], 0
        while i < len(t):
            m = assign_at(t, i) if ascii_lower(t[i]) in "pstar" else None
            if m:
                if m[1] >= 8:
                    found.append((i, 0, m[0]))
                i = m[0]
            else:
                i += 1
        found += [(s, 1, e) for s, e in runs(t, "AKIA", upper) if e - s >= 16]
        i = 0
        while i < len(t):
            e = i
            while e < len(t) and t[e] in hexes:
                e += 1
            if e - i >= 32:
                found.append((i, 2, e))
            i = max(e, i + 1)
        g = got[r["doc_id"]]
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [sum(k == x for _, k, _ in found) for x in range(3)]
        names = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        assert g["base_sha256"] == hashlib.sha256(names.encode()).hexdigest()
        seen += len(found)
    assert seen


def test_secret_spans(spark):
    key = "AKIA" + "B" * 12
    rows = ["password=hunter22 x", "Token: 'abc'", key, "AKIA1", "f" * 32 + "g", "api-key: zzzzzzzz", "API_KEY = \"Zz9-Zz9-Zz9q\"", "password: secret: abcdefgh12", "ſecret=abcdefgh", "my pwd is tR7#kq9!Lm2", None, "é password=aaaaaaaa1"]
    got = [r for r in secret_scan.scan(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r["n_assign"] for r in got] == [1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    assert [r["n_access"] for r in got] == [0, 0, 1] + [0] * 9 and got[4]["n_hex"] == 1
    assert got[0]["spans"].startswith("assign:0:17") and got[11]["spans"].startswith("assign:2:20")
    assert got[9]["spans"] == "guess:10:21"
    assert secret_scan.mask("a password=hunter22 b") == "a [ASSIGN] b"
    assert secret_scan.mask("nothing") == "nothing"


def test_forward_backward_is_the_sum_over_tag_sequences():
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(2, 2))
    for n in (1, 2, 5, 9):
        u = rng.normal(size=n) * 2
        total, on = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            # The step into the first tag is from either, as the recursion starts from both alike.
            first = np.exp(trans[0, tags[0]]) + np.exp(trans[1, tags[0]])
            w = first * np.exp(sum(u[i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            on += w * np.array(tags)
        assert np.allclose(toxicity.marginals(u, trans, np.array([n])), on / total)
    counts = np.array([0, 100, 1, 0, 33, 32, 64, 7])
    u = rng.normal(size=counts.sum())
    whole = toxicity.marginals(u, trans, counts)
    at = 0
    for c in counts:
        assert np.allclose(whole[at : at + c], toxicity.marginals(u[at : at + c], trans, np.array([c])))
        at += c


def test_toxicity_finds_planted_words():
    rng = np.random.default_rng(7)
    plain = [f"w{i}" for i in range(400)]
    texts, labels = [], []
    for i in range(300):
        words = list(rng.choice(plain, 60))
        if i % 4 == 0:
            for bad in rng.choice(["vileone", "vilethat", "nasty"], 2):
                words.insert(int(rng.integers(60)), bad)
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:200], labels[:200])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(104)), pa.array([*texts[200:], "", None, "É nasty é", "vilenew thing"])], names=["doc_id", "text"])
    sent = type("Sent", (), {"value": model})
    out = pa.Table.from_batches(list(toxicity._scorer(sent)(iter([batch])))).to_pylist()
    right = sum((r["score"] >= 0.5) == bool(y) for r, y in zip(out, labels[200:], strict=False))
    assert right >= 98 and out[100]["score"] == out[101]["score"] < 0.5
    spans = out[102]["spans"]
    assert [("É nasty é")[s["start"] : s["end"]] for s in spans] == ["nasty"]
    assert out[103]["score"] > out[100]["score"]  # by its prefix


def test_held_out_accuracy(spark, sf):
    import zlib

    from docengine.llm.quality import op10_quality
    from docengine.llm.toxicity import op7_toxicity

    d = sf.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for run, name, n, fold, least in ((op7_toxicity, "toxic", 3, 1, 0.9), (op10_quality, "quality", 5, 0, 0.95)):
        rows = run(spark, d).collect()
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == fold) and 0 <= r["score"] <= 1
        held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
        right = sum(r["predicted"] == labels[r["doc_id"]][name] for r in held)
        assert right >= least * len(held)
        # The rarer label by itself.
        rare = min((0, 1), key=lambda y: sum(labels[r["doc_id"]][name] == y for r in held))
        true = [r for r in held if labels[r["doc_id"]][name] == rare]
        said = [r for r in held if r["predicted"] == rare]
        both = sum(r["predicted"] == rare for r in true)
        assert both >= 0.75 * len(true) and both >= 0.75 * len(said), (name, both, len(true), len(said))


def test_discriminant_is_the_plain_formula():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(90, 3)) * 2 + 1])
    y = np.array([0] * 60 + [1] * 90)
    m = quality.fit(x, y)
    z = (x - x.mean(0)) / x.std(0)
    pooled = sum(np.cov(z[y == c].T) * ((y == c).sum() - 1) for c in (0, 1)) / (len(z) - 2)
    logs = []
    for c in (0, 1):
        s = (1 - quality.TO_POOLED) * np.cov(z[y == c].T) + quality.TO_POOLED * pooled
        s = (1 - quality.TO_IDENTITY) * s + quality.TO_IDENTITY * np.trace(s) / 3 * np.eye(3)
        diff = z - z[y == c].mean(0)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (diff @ np.linalg.inv(s) * diff).sum(1))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_prior_is_that_of_all_labels(spark, monkeypatch):
    """What a sample leaves out counts for the prior all the same; a text over the bound is passed over, others are not."""
    rows = [(i, "good words in a row here " * (i % 7 + 1)) for i in range(90)] + [(100 + i, "# # # | | bad " * (i % 5 + 1)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows] + [(None, 1), (5000, None)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    whole = quality.trained(docs, labels, F.lit(True))
    monkeypatch.setattr(quality, "SAMPLE_PER_CLASS", 10)
    few = quality.trained(docs, labels, F.lit(True))
    assert np.allclose(np.exp(few.log_prior), [0.1, 0.9]) and np.allclose(whole.log_prior, few.log_prior)
    size = {i: len(t) for i, t in rows}
    got = toxicity.sample(docs, labels, "quality", F.lit(True), 100, 1000)
    assert 0 < sum(len(t) for t, y in got if y == 1) <= 1000 and sum(len(t) for t, y in got if y == 0) == sum(size[i] for i in range(100, 110) if i in size)
    assert toxicity.sample(docs.limit(0), labels, "quality", F.lit(True), 100, 1000) == []


def test_license_base_and_rules(spark, some):
    extra = ["SPDX-License-Identifier: Apache-2.0", "GNU  general-public license, version 3 and MIT License", "cc by cc by-nc 4.0", "mit der Lizenz", None, "Licensed under the terms of the Mozilla Public License 2.0", "all rights reserved all rights reserved", "gplv2 a-gpl2 mpl 2.0 example", "cc\tby-sa 3.0", "see gnu.org/licenses/gpl-3.0", "python software foundation licence 2"]
    frame = some.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in license_scan.scan(frame).collect()}
    for r in frame.collect():
        low = ascii_lower(r["text"] or "")
        words = WORD.findall(low)
        hits = [(i, label) for p, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"]) == (len(words), len(hits))
        assert g["base_labels"] == ",".join(sorted({label for _, label in hits}))
        assert (g["first_word"], g["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        found = []
        for rule in license_scan.rules():
            # A keyword of one word or a mark is part of any match; of several words, it asks for single spaces.
            if " " not in rule["kw"] or rule["kw"] in low:
                found += [(rule["p"], m.start(), m.end(), rule["label"], rule["w"]) for m in re.finditer(rule["re"], low, re.A)]
        left = [x for x in found if not any(y[1] <= x[1] and y[2] >= x[2] and (y[0] < x[0] or y[0] == x[0] and y[2] - y[1] > x[2] - x[1]) for y in found)]
        assert set(g["labels"].split(",")) - {""} == {x[3] for x in left} | {label for _, label in hits}, r["text"]
    assert got[10_000]["labels"] == "apache-2.0" and got[10_003]["labels"] == "" and "mpl-2.0" in got[10_005]["labels"]
    assert len(license_scan.rules()) >= 200
    for rule in license_scan.rules():
        assert any(g in rule["kw"] for g in license_scan.GATE), rule


def test_signatures(spark):
    from pyspark.sql import functions as F

    common = set(spotsigs.COMMON) | {"^"}

    def brute(text):
        words = ["^", *re.sub(r"[\W_]+", " ", text.lower()).split()]
        out = set()
        for i, w in enumerate(words):
            if w not in common:
                continue
            chain, j = [], i + 1
            while len(chain) < spotsigs.CHAIN and j < len(words):
                while j < len(words) and words[j] in common:
                    j += 1
                if j >= len(words) or words[j] in common:
                    break
                chain.append(words[j])
                j += 1
            if len(chain) == spotsigs.CHAIN:
                out.add(" ".join([w, *chain]))
        return out

    texts = ["The of quick brown fox and the lazy the dog.", "", "the the the", "a b", "alpha beta the gamma", "Le chat et la souris dans une maison"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(spotsigs.signatures(F.col("text")).alias("s"))
    assert [set(r["s"]) for r in frame.collect()] == [brute(t) for t in texts]


def test_signatures_skip_all_common_words(spark):
    """Runs of common words of any length before either word of a chain, and one that ends the text."""
    from pyspark.sql import functions as F

    common = set(spotsigs.COMMON) | {"^"}

    def brute(text):
        words = ["^", *re.sub(r"[\W_]+", " ", text.lower()).split()]
        rest = [(i, [w for w in words[i + 1 :] if w not in common][: spotsigs.CHAIN]) for i, w in enumerate(words) if w in common]
        return {" ".join([words[i], *chain]) for i, chain in rest if len(chain) == spotsigs.CHAIN}

    run = " ".join(["of", "the", "and", "to", "in"] * 3)
    texts = [f"{run} alpha {run} beta {run} gamma {run}", f"alpha {run} beta", "the " * 20_000, "the " * 9 + "alpha beta"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(spotsigs.signatures(F.col("text")).alias("s"))
    assert [set(r["s"]) for r in frame.collect()] == [brute(t) for t in texts[:2]] + [set(), brute(texts[3])]


def test_tree_loses_no_pair():
    """The pairs of the R-tree joined with itself, against all pairs, with sizes that rise in steps."""
    from docengine.llm import ngram_jaccard as nj

    rng = np.random.default_rng(11)
    points, n = [], []
    for _ in range(5):
        base = rng.integers(0, 1 << 62, 400, dtype=np.int64)
        for size in np.concatenate([rng.integers(1, 40, 40), rng.integers(100, 130, 40)]).tolist():
            own = np.unique(np.concatenate([base[: int(size * rng.uniform(0.4, 1))], rng.integers(0, 1 << 62, 400, dtype=np.int64)])[:size])
            points.append(np.bincount((own >> 40) % nj.GROUPS, minlength=nj.GROUPS))
            n.append(len(own))
    points, n = np.array(points, np.int32), np.array(n)
    got = nj.plausible(points, n, 75)
    assert (got == got.T).all()
    some = 0
    for i, j in itertools.combinations(range(len(n)), 2):
        want = 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) and int(np.minimum(points[i], points[j]).sum()) * 175 >= 75 * (n[i] + n[j])
        assert got[i, j] == want
        some += want
    assert 0 < some < 2000


def test_very_long_words_and_texts(monkeypatch):
    """Hashes do not depend on how the bytes are cut."""
    from docengine.llm import bytewords as bw
    from docengine.llm.ngram_jaccard import shingles

    texts = ["x" * 900 + " a b " + "y" * 70 + " c d e f", "one two three four five six " * 30, "", "z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    whole = shingles(data, offsets, 5)
    monkeypatch.setattr(bw, "BLOCK_BYTES", 64)
    cut = shingles(data, offsets, 5)
    assert all((x == y).all() for x, y in zip(whole, cut, strict=True))
