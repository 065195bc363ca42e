"""The operators that SQL can express, against their SQL; and the edge cases of all."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docengine.llm import (
    chat_format,
    components,
    decontamination,
    license_scan,
    ngram_jaccard,
    queries,
    quality,
    secret_scan,
    source_mix,
    spotsigs,
    token_counts,
    toxicity,
)
from tests.test_queries import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf, duck):
    made = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made.columns, made.collect()) == rows(want.columns, want.fetchall())


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_every_row_has_a_row(spark, odd, none, sf):
    import public_tokenizers

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = spark.createDataFrame([(1, None), (None, "x y"), (2, "same words"), (2, "to see"), (3, "")], "item_id long, text string")
    path = public_tokenizers.path(token_counts.TOKENIZER)
    runs = {
        "tokens": lambda d: token_counts.token_counts(d, path),
        "bench": lambda d: decontamination.decontaminate(d, bench),
        "no bench": lambda d: decontamination.decontaminate(d, bench.limit(0)),
        "mix": source_mix.mix,
        "secrets": secret_scan.scan,
        "jaccard": ngram_jaccard.jaccard_classes,
        "licenses": license_scan.scan,
        "toxic": lambda d: toxicity.toxic_scores(d, labels.limit(0)),
        "spots": spotsigs.fingerprints,
        "quality": lambda d: quality.score(d, quality.fit(quality.statistics_of([]), None)),
    }
    n = odd.count()
    for name, run in runs.items():
        assert run(odd).count() == n, name
        assert run(none).count() == 0, name
    found = by_id(runs["bench"](odd))
    assert [r["items"] for r in found[100]] == [["2"], ["2"]] and found[100][0]["n_hit"] == 4
    assert {r["n_words"] for r in found[0] + found[1] + found[2]} == {0}
    empty = {name: by_id(runs[name](odd)) for name in ("tokens", "secrets", "licenses", "toxic", "spots", "quality", "mix")}
    for i in (0, 1):  # null and empty
        for r in empty["tokens"][i][:1]:
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (0, 0, False)
        for r in empty["secrets"][i][:1]:
            assert (r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) == (0, 0, 0, "") and r["base_sha256"] == hashlib.sha256(b"").hexdigest()
        for r in empty["licenses"][i][:1]:
            assert (r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, 0, None, "", 0.0)
        for r in empty["spots"][i][:1]:
            assert (r["n_chars"], r["fingerprint"]) == (0, "")
        for r in empty["mix"][i][:1]:
            assert (r["size"], r["taken"]) == (0, 0)
    assert len({r["score"] for name in ("toxic", "quality") for i in (0, 1, 2) for r in empty[name][i]}) <= 2
    near = by_id(runs["jaccard"](odd))
    assert [r["component_id"] for r in near[100]] == [100, 100] and near[0][0]["n_shingles"] == 0 and near[3][0]["n_shingles"] == 1


def test_winnowing_in_blocks_equals_one_block(spark, some, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = decontamination.judged(decontamination.decontaminate(some, bench)).drop("hit_spans")
    many = decontamination.judged(decontamination.decontaminate(some, bench, block_bytes=900)).drop("hit_spans")
    assert rows(one.columns, one.collect()) == rows(many.columns, many.collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (None, 3), (200, 150), (150, 170)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[x] for x in (100, 101, 103)} == {100} and {found[x] for x in (150, 170, 200)} == {150}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_loses_no_link(spark):
    """Chains of near copies whose ends are no copies, one passage in many texts, and copies of copies."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(30):
        docs.append([word() for _ in range(40)] + passage)
    base = [word() for _ in range(120)]
    for step in range(12):  # each a little further from the first
        base = base[:]
        for j in range(2):
            base[step * 8 + j] = word()
        docs.append(base)
    docs += [docs[0], docs[31][:-3], [w.upper() for w in docs[33]]]
    texts = [" ".join(d) for d in docs]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_classes(frame).collect()}
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(sets)))
    for _ in sets:
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert [found[i] for i in range(len(sets))] == root
    kept = ngram_jaccard.keep_one(frame, ngram_jaccard.jaccard_classes(frame))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_reply_trees(spark):
    msgs = [("t", 1, None, 1.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 99, 0.5), ("u", 1, 2, 1.0), ("u", 2, 1, 1.0), ("u", 3, 1, 1.0)]
    msgs += [("v", i, i - 1 if i else None, 0.1) for i in range(40)] + [("v", 2, 77, 9.0), (None, 1, None, 1.0), ("w", None, None, 1.0), ("x", 1, None, None)]
    frame = spark.createDataFrame(msgs, "tree string, id long, parent long, score double")
    got = {}
    for r in chat_format.reply_paths(frame, best=9).orderBy("depth").collect():
        got.setdefault((r["tree"], r["leaf"], r["rank"], round(r["score"], 6)), []).append(r["id"])
    assert got == {("t", 4, 1, 11.0): [1, 2, 4], ("t", 3, 2, 6.0): [1, 3], ("t", 5, 3, 0.5): [5], ("v", 39, 1, 4.0): list(range(40)), ("x", 1, 1, 0.0): [1]}
    assert {(r["tree"], r["leaf"]) for r in chat_format.reply_paths(frame).collect()} == {("t", 4), ("v", 39), ("x", 1)}


def test_odd_conversations(spark):
    """Rows without a conv_id are one conversation; repeated rows are turns; other columns do not matter."""
    rows = [(None, 1, "user", "a", 1), (None, 2, "assistant", "b", 1), (7, None, None, None, 1), (7, 1, "assistant", "x", 1), (7, 1, "assistant", "x", 2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree int")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.conversations_formatted(frame)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {None: (2, 1), 7: (3, 2)}
    assert got[None]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert got[7]["loss_sha256"] == hashlib.sha256(b"xx").hexdigest()
    assert chat_format.read_back(chat_format.conversations_formatted(frame.limit(0))).collect() == []


def test_texts_of_one_word_cost_no_more(spark):
    """Repeated words: every place of a document matches every place of an item."""
    import time

    bench = spark.createDataFrame([(1, "buffalo " * 3000), (2, "buffalo " * 14), (3, "a b " * 500), (4, "buffalo " * 5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "buffalo " * 100_000), (2, "b a " * 8 + "x"), (3, "buffalo " * 12), (4, "b a b a")], "doc_id long, text string")
    began = time.time()
    got = by_id(decontamination.decontaminate(docs, bench))
    assert time.time() - began < 60
    assert (got[1][0]["n_hit"], got[1][0]["items"]) == (100_000, ["1", "2", "4"])
    assert (got[2][0]["n_hit"], got[2][0]["items"]) == (16, ["3"])
    assert (got[3][0]["n_hit"], got[3][0]["items"]) == (12, ["4"]) and got[4][0]["n_hit"] == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|><|user|>x", "\\e\\l\\", None, "", "a\nb", "é😀<", "\\\\<<[[||"]
    frame = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 0, None, "x")], "conv long, turn long, role string, text string")
    done = chat_format.formatted(frame).withColumn("turns", chat_format.parsed(F.col("formatted")))
    got = {r["conv"]: r for r in done.collect()}
    assert [t["text"] for t in got[1]["turns"]] == [t or "" for t in hard] and got[2]["turns"][0]["role"] == ""
    text = got[1]["formatted"]
    assert "[INST]" not in text and text.count("<|end|>") == len(hard)
    spans = [text[s["start"] : s["end"]] for s in got[1]["loss_spans"]]
    assert len(spans) == 4 and spans[2] == "a\nb" or spans


def test_mix_brute_force(spark, some):
    got = source_mix.mix(some).collect()
    assert rows(["a"], [(r["doc_id"],) for r in got]) == rows(["a"], [(r["doc_id"],) for r in some.collect()])
    again = source_mix.mix(some.repartition(7)).collect()
    key = lambda r: r["doc_id"]
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(again, key=key)]
    source = {r["doc_id"]: r["source"] for r in some.collect()}
    size, taken, target, largest = {}, {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    weight = {s: source_mix.WEIGHTS[i % 3] for i, s in enumerate(sorted(size))}
    want, open_, left = {}, set(size), float(sum(size.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        open_ -= over
    want |= share
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= largest[s]


def test_mix_caps_and_null_source(spark):
    rows_ = [(i, "w " * 10, "a") for i in range(3)] + [(10 + i, "w " * 100, "b") for i in range(20)] + [(50, "w w", None), (51, None, None), (52, "", "z")]
    got = {r["doc_id"]: r for r in source_mix.mix(spark.createDataFrame(rows_, "doc_id long, text string, source string")).collect()}
    assert got[0]["target"] == 90.0 and all(got[i]["copies"] == 3 for i in range(3))
    assert got[50]["target"] == 6.0 and got[51]["taken"] == 0 and got[52]["target"] == 0.0
    total = sum({r["source_size"]: r["target"] for r in got.values()}.values())
    assert abs(total - 2032) < 1e-6


def test_mix_ties(spark):
    rows_ = [(i, "w " * 50, s) for i, s in enumerate("abcdef")]
    got = source_mix.targets(spark.createDataFrame([(50, s) for _, _, s in rows_], "size long, source string")).collect()
    assert {r["source"]: r["target"] for r in got} == {"a": 93.75, "d": 93.75, "b": 37.5, "e": 37.5, "c": 18.75, "f": 18.75}


def test_tokens_against_the_library(spark, some):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.TOKENIZER)
    whole = Tokenizer.from_file(path)
    hard = ["don't SAY 'tis we'll I'D 's'say ''s", "<|endoftext|> a<|startoftext|>b <|x|>", "été İstanbul ΣΣ ẞ 12²3 ½ x_y", "\ttab\x1cx\x85y", "你好😀😀 a.b", "한", "é", "A" * 4000 + " 1"]
    frame = some.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    for most in (1 << 18, 50):
        got = {r["doc_id"]: r for r in token_counts.token_counts(frame, path, head_tokens=most).collect()}
        for r in frame.collect():
            assert got[r["doc_id"]]["n_tokens"] == len(whole.encode(r["text"], add_special_tokens=False)), r["text"][:50]
            assert got[r["doc_id"]]["n_bytes"] == len(r["text"].encode())


def test_next_documents_and_edits(spark, texts, some):
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    got = by_id(spotsigs.fingerprints(some))
    for i, t in texts.items():
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[after[i]][:half]
        assert got[i][0]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


@pytest.mark.parametrize("per_range", [3, 1000])
def test_next_documents_of_any_ids(spark, monkeypatch, per_range):
    """Ids far apart, of both signs, repeated and null; in several ranges and in one."""
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", per_range)
    ids = [0, 1 << 60, -(1 << 63), (1 << 63) - 1, 5, 5, 6, 7, -3, *range(100, 120), None, None]
    rows = [(i, f"the text {n} of words number{n} and more like {n * 7}") for n, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = set()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.add((i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert {(r["doc_id"], r["edited_sha256"]) for r in spotsigs.fingerprints(frame).collect()} == want
    assert [tuple(r) for r in spotsigs.fingerprints(frame.where("doc_id = 6")).select("doc_id", "near_next").collect()] == [(6, 1.0)]


@pytest.mark.parametrize("members", [4, 64])
def test_near_copies_against_all_pairs(spark, monkeypatch, members):
    """Near copies far from each other in doc_id order, equal sets, texts without signatures, rows without an id."""
    import itertools
    import random

    monkeypatch.setattr(spotsigs, "PART_MEMBERS", members)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghjk") for _ in range(5))
    docs = []
    for n in (3, 4, 8, 20, 45):
        base = [word() for _ in range(2 * n)]
        for copy in range(8):
            own = [word() if rng.random() < 0.02 * copy else w for w in base[: len(base) - copy // 3]]
            docs.append(" the ".join(" ".join(own[i : i + 2]) for i in range(0, len(own), 2)))
    rng.shuffle(docs)
    docs += [docs[0].upper(), "no", "no", "", None, docs[1]]
    rows = [(None if i == len(docs) - 1 else 3 * i, t) for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(r["s"]) for r in frame.select(spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()]
    near = {i: set() for i in range(len(docs))}
    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if len(a & b) / len(a | b) >= spotsigs.NEAR if a and b else (docs[i] or "") == (docs[j] or ""):
            near[i].add(j)
            near[j].add(i)
    assert any(abs(i - j) > 1 and sets[i] != sets[j] for i in near for j in near[i])
    want = [(d, len(near[i]), min(x for x in [d, *(rows[j][0] for j in near[i])] if x is not None)) for i, (d, _) in enumerate(rows)]
    got = [tuple(r) for r in spotsigs.fingerprints(frame).select("doc_id", "n_near", "near_id").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("members,family", [(8, 2), (64, 16)])
def test_families_of_near_copies_are_counted_without_their_pairs(spark, monkeypatch, members, family):
    """Families of many different near copies, tight, loose and half alike, with copies of members, against all pairs."""
    import itertools
    import random

    monkeypatch.setattr(spotsigs, "PART_MEMBERS", members)
    monkeypatch.setattr(spotsigs, "FAMILY_MEMBERS", family)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfghjk") for _ in range(6))
    base = [word() for _ in range(120)]
    docs = []
    for origin, copies, share in ((base, 90, 0.02), (base[:100] + [word() for _ in range(20)], 30, 0.02), ([word() for _ in range(80)], 40, 0.06)):
        for _ in range(copies):
            own = [word() if rng.random() < share else w for w in origin]
            docs.append(" the ".join(" ".join(own[i : i + 2]) for i in range(0, len(own), 2)))
    docs += docs[::9]
    rng.shuffle(docs)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = [set(r["s"]) for r in frame.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    near = {i: {i} for i in range(len(docs))}
    pairs = 0
    for i, j in itertools.combinations(range(len(docs)), 2):
        if len(sets[i] & sets[j]) >= spotsigs.NEAR * len(sets[i] | sets[j]):
            near[i].add(j)
            near[j].add(i)
            pairs += sets[i] != sets[j]
    compared, real = [], spotsigs._candidates
    monkeypatch.setattr(spotsigs, "_candidates", lambda *a, **k: (compared.append(found := real(*a, **k)), found)[1])
    monkeypatch.setattr(spotsigs.Scratch, "drop", lambda *a: None)
    got = [tuple(r) for r in spotsigs.fingerprints(frame).select("doc_id", "n_near", "near_id").collect()]
    assert sorted(got) == [(i, len(x) - 1, min(x)) for i, x in near.items()]
    assert pairs > 4000 and 0 < compared[0].count() < pairs / 2


@pytest.mark.parametrize("members", [16, 64])
def test_centres_of_families_need_no_row_for_each_signature_of_a_member(spark, monkeypatch, members):
    """What more than half of a family have, against counts; the rows made for it follow the parts, not the members."""
    import random
    from collections import Counter

    monkeypatch.setattr(spotsigs, "PART_MEMBERS", members)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfghjk") for _ in range(6))
    docs = []
    for copies in (17, 40, 60):
        base = [word() for _ in range(120)]
        for _ in range(copies):
            own = [word() if rng.random() < 0.03 else w for w in base]
            docs.append(" the ".join(" ".join(own[i : i + 2]) for i in range(0, len(own), 2)))
    kept, made, real = {}, [], spotsigs.Scratch.write

    def rows(plan):
        """Rows that the Generate nodes of a plan that has run have made."""
        inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if plan.nodeName().endswith("QueryStage") else None
        below = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
        return own + sum(rows(x) for x in below)

    def write(self, df, name):
        kept[name] = real(self, df, name)
        if name == "centres":
            df.collect()
            made.append(rows(df._jdf.queryExecution().executedPlan()))
        return kept[name]

    monkeypatch.setattr(spotsigs.Scratch, "write", write)
    monkeypatch.setattr(spotsigs.Scratch, "drop", lambda *a: None)
    spotsigs.fingerprints(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    sets: dict[int, list] = {}
    for r in kept["kin"].select("family", "fp").collect():
        sets.setdefault(r["family"], []).append(r["fp"])
    centres = {r["family"]: (r["c"], r["centre"]) for r in kept["centres"].collect()}
    assert len(sets) >= 3 and centres.keys() == sets.keys()
    for family, (c, centre) in centres.items():
        counts = Counter(h for fp in sets[family] for h in fp)
        assert c == len(sets[family]) and len(centre) == len(set(centre))
        if c <= members:
            assert set(centre) == {h for h, k in counts.items() if 2 * k > c}
        else:
            assert {h for h, k in counts.items() if 4 * k > 3 * c} <= set(centre) <= {h for h, k in counts.items() if 4 * k > c}
    signatures = sum(len(fp) for own in sets.values() for fp in own)
    assert 0 < made[0] <= signatures / 8


def test_near_pairs_are_looked_at_once_and_few_others(spark):
    """Of a family and of sets alike by length only, in one part: every near pair is compared once, most others never."""
    import itertools
    import random

    rng = random.Random(5)
    base = rng.sample(range(-(2**31), 2**31), 100)
    sets = [set(rng.sample(base, 95)) | set(rng.sample(range(2**31), i % 6)) for i in range(20)]
    sets += [set(rng.sample(range(-(2**31), 2**31), 95 + i)) for i in range(20)]
    rows = [(1, (-9, 0), (-9, 0), (-9, 0), i, len(x), i, 1, [], sorted(x)) for i, x in enumerate(sets)]
    spot = "struct<length: int, part: int>"
    kinds = f"head long, lo {spot}, hi {spot}, at {spot}, rep long, n long, first long, members long, low array<long>, fp array<int>"
    got = [(r["i"], r["j"]) for r in spotsigs._candidates(spark.createDataFrame(rows, kinds), 75).selectExpr("a.rep as i", "b.rep as j").collect()]
    near = {(i, j) for i, j in itertools.combinations(range(40), 2) if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    assert len(near) >= 100 and near <= set(got)
    assert len(got) == len(set(got)) and all(i < j for i, j in got)
    assert len(set(got) - near) <= 100  # of the other 590 pairs at most


def test_jaccard_counts_every_link(spark, monkeypatch):
    """A group of many distinct near copies, some of them twice, over several squares, against all pairs."""
    import random

    monkeypatch.setattr(ngram_jaccard, "PART_MEMBERS", 4)
    monkeypatch.setattr(ngram_jaccard, "STRIP", 16)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    docs = []
    for _ in range(20):
        copy = base[:]
        for j in rng.sample(range(120), rng.choice([1, 2, 3])):
            copy[j] = word()
        docs.append(copy)
    docs += [docs[0], docs[0], docs[3], [word() for _ in range(9)]]
    texts = [" ".join(d) for d in docs] + ["", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(len((t or "").split()) - 4)} for t in texts]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    want = {i: sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    assert 0 < min(want[i] for i in range(20)) < 22
    assert {r["doc_id"]: r["n_links"] for r in ngram_jaccard.jaccard_classes(frame).collect()} == want
    first = {i: min(j for j, b in enumerate(sets) if b == a) for i, a in enumerate(sets)}
    pairs = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a != b and linked(a, b) and first[i] == i and first[j] == j}
    assert {tuple(r) for r in ngram_jaccard.linked_pairs(frame).collect()} == pairs


def test_jaccard_of_a_large_group(spark, monkeypatch):
    """Many families of near copies of all sizes with a passage that all texts share, repeated ids, null ids: every row
    against all pairs."""
    import random

    monkeypatch.setattr(ngram_jaccard, "PART_MEMBERS", 16)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    docs = []
    for n in (1, 3, 6, 9, 14, 25, 60, 150):
        base = [word() for _ in range(n)] + (passage if n > 20 else [])
        for _ in range(30 if n != 60 else 120):
            own = [word() if rng.random() < 0.03 else w for w in base][: len(base) - rng.randrange(3)]
            docs.append(own)
    rng.shuffle(docs)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rows += [(5, rows[9][1]), (None, rows[7][1]), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")

    def shingled(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingled(t) for _, t in rows]
    ids = [i for i, _ in rows]
    root = {i: i for i in ids if i is not None}
    n_links = [0] * len(rows)
    edges = []
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and None not in (ids[i], ids[j]) and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                edges.append((ids[i], ids[j]))
                n_links[i] += ids[i] != ids[j] or sets[i] == sets[j]
    for _ in range(20):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = sorted(((ids[i], len(sets[i]), root.get(ids[i]), n_links[i]) for i in range(len(rows))), key=repr)
    got = sorted((tuple(r) for r in ngram_jaccard.jaccard_classes(frame).collect()), key=repr)
    assert got == want


def test_rows_without_an_id_mix_like_others(spark):
    """Many rows that are alike: each is a row of its own, and no group of the tree holds them all."""
    rows = [(None, "a b c", "s")] * 400 + [(1, "a b", "s")] * 50 + [(i, "x " * (i % 9 + 1), "t") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(frame).collect()
    assert len(got) == len(rows)
    for first in {r["target"] for r in got}:
        own = [r for r in got if r["target"] == first]
        assert abs(sum(r["taken"] for r in own) - first) <= 9
    again = source_mix.mix(frame.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_other_tokenizer_files_are_refused(spark, tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path(token_counts.TOKENIZER), encoding="utf-8") as f:
        said = json.load(f)
    said["normalizer"]["normalizers"] = said["normalizer"]["normalizers"][:2]
    (tmp_path / "other.json").write_text(json.dumps(said))
    with pytest.raises(ValueError, match="divides texts"):
        token_counts.token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path / "other.json"))


def test_very_long_texts(spark, sf):
    """A text of megabytes and a word of a megabyte, among short ones, through every operator on documents."""
    import public_tokenizers

    words = ["the", "quick", "fox", "of", "brown", "things", "and", "jumps"]
    text = " ".join(words[(i * i + i // 7) % 8] + str(i % 977) for i in range(300_000))
    rows = [(1, text), (2, "z" * 1_000_000), (3, "short the text of one"), (4, text + " more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    bench = spark.createDataFrame([(1, text[:4000])], "item_id long, text string")
    near = by_id(ngram_jaccard.jaccard_classes(frame))
    assert near[4][0]["component_id"] == 1 and near[2][0]["n_shingles"] == 1 and near[1][0]["n_links"] == 1
    hit = by_id(decontamination.decontaminate(frame, bench))
    assert hit[1][0]["n_hit"] >= 400 and hit[1][0]["n_words"] == 300_000 and hit[2][0]["n_hit"] == 0
    tokens = by_id(token_counts.token_counts(frame, public_tokenizers.path(token_counts.TOKENIZER)))
    assert tokens[1][0]["over_limit"] and tokens[2][0]["n_bytes"] == 1_000_000
    spots = by_id(spotsigs.fingerprints(frame))
    assert spots[1][0]["near_id"] == 1 and spots[4][0]["near_id"] == 1
    labels = spark.read.parquet(f"{sf}/labels.parquet").limit(0)
    for run in (secret_scan.scan, license_scan.scan, source_mix.mix, lambda d: toxicity.toxic_scores(d, labels), lambda d: quality.score(d, quality.fit(quality.statistics_of([]), None))):
        assert run(frame).count() == 4
