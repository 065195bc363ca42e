"""Secret scans: fixed credential patterns, and values in credential contexts that would be costly to guess.

The base patterns (``assign``, ``access``, ``hex``) are taken as they are. Beyond them, a value that follows a
credential word is split into dictionary words, dates, repeats, sequences, keyboard walks and brute-force spans by
dynamic programming, so that the product of the parts' guess counts is smallest; a value that still needs
``MIN_GUESSES_LOG10`` decimal digits of guesses is a span of kind ``guess``. Values that a guesser reaches early
(placeholders, walks, dates, one or two plain words) add nothing; three words are a passphrase.

The dictionary has common passwords, word forms made by a rule, and at most MOST_WORDS words of letters that most rows of the
corpus itself hold, ranked by that: prose after a credential word is no secret. The words are counted in a pass
over the texts with partial sums; the scan is one more pass without a shuffle, in which a linear-time filter in Arrow
finds the texts worth a closer look.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bytewords as bw
from docengine.llm.spill import table, written

KINDS = ("assign", "access", "hex", "guess")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|signing|encryption)[_\-\x20]?key|credentials?|auth|bearer)"""
    r"""["']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*["']?([^\s"'<>,;(){}]{6,})""",
    re.I | re.A,
)
MAYBE = r"(?i:pass|pwd|secret|token|key|credential|auth|bearer)|AKIA|[0-9a-f]{32}"
MIN_GUESSES_LOG10 = 10.0

# Common passwords and password words, most frequent first.
COMMON = """password 123456 12345678 qwerty abc123 letmein monkey dragon iloveyou trustno1 sunshine master welcome shadow
ashley football jesus michael ninja mustang password1 admin root user guest test login secret token changeme default
example sample demo dummy placeholder none null true false your key value here hello world love princess flower summer
winter spring autumn baseball batman superman starwars computer internet server database access private public system
manager service account company london paris berlin madrid orange apple banana cookie coffee cheese pepper ginger
charlie jordan thomas robert daniel andrew jessica jennifer michelle hunter killer soccer hockey ranger tiger eagle
silver golden purple yellow black white green blue red the and for you are""".split()
# Beginnings and endings that long common words are made of.
STEMS = """act addit administr allow amount applic approv associ assum attach authentic author avail basic calcul certific
collect commerc commun configur confirm connect consider construct continu convers correct creat custom decis default defin
deliver depend deploy describ design detail determin develop direct discuss distribut document educ element encrypt environ
establish examin express extens financ function generat govern identif implement import increas independ individu inform
initi instal instruct integr interest intern introduct invest locat manag mean member modif necess notif number object
observ occur operat opinion organ origin owner parameter particip particular perform permiss person popul posit possib
prefer prepar present process produc product profess program project protect provid publish quest receiv recognis refer
regist regul relat repres requir research resid resourc respons restrict result review select separ sequenc session
signific situat special specif standard statement storag structur student suggest support technic tradit transact transfer
transform translat understand universit updat valid variabl verif""".split()
ENDINGS = """ s e es ed er ers ing ings ion ions ation ations ication ications ition itional ional ally al ally ant ance ances ence
ent ents ment ments mental able ible ability ibility ity ities ive ively ship ships ness y ies ied ic ical ise ised ize ized
izing ator ators or ors ary ory ful less ly""".split(" ")
#: Words of the corpus that the dictionary takes, and how long its words are.
MOST_WORDS = 50_000
LEAST_WORD, LONGEST_WORD = 3, 24
#: Words that one task counts before it hands on its counts.
HELD_WORDS = 50_000
#: Bytes of text whose words are split at once; lists of words take many times as much.
COUNT_BYTES = 1 << 18
#: Bytes of text that are masked at once.
MASK_BYTES = 1 << 20


def ranked(words: list[str]) -> dict[str, int]:
    """Words to ranks: common passwords first, then the given words in order, then the forms made of stems and endings."""
    forms = (stem + end for end in ENDINGS for stem in STEMS)
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *words, *forms]))}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def done() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for texts, _, _ in bw.blocks(batches, limit=COUNT_BYTES):
        words = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.column(0), "")), r"[^a-z]+")
        size = pc.utf8_length(words.flatten())
        mine = pc.and_(pc.greater_equal(size, LEAST_WORD), pc.less_equal(size, LONGEST_WORD))
        # Once for each row.
        rows = pa.table([pc.list_parent_indices(words), words.flatten()], names=["row", "word"]).filter(mine).group_by(["row", "word"]).aggregate([])
        for x in pc.value_counts(rows["word"].combine_chunks()):
            word, n = x["values"].as_py(), x["counts"].as_py()
            held[word] = held.get(word, 0) + n
        if len(held) >= HELD_WORDS:
            yield done()
    if held:
        yield done()


def common_words(documents: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """At most ``most`` words of Latin letters that most rows hold, in that order, ties by the word: those above a frequency
    that a histogram of logarithms gives, so that no more than these come to the driver. Words of one row are left out."""
    counted = documents.select("text").mapInArrow(bw.handing_back(_counts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = written(counted.withColumn("step", F.floor(F.log2("n") * 8)), "secret-words")
    steps = counted.groupBy("step").agg(F.count(F.lit(1)).alias("c")).collect()
    left, least = most, None
    for step, c in sorted(((r["step"], r["c"]) for r in steps), reverse=True):
        if c > left:
            break
        left, least = left - c, step
    rows = counted.where(F.col("step") >= least).select("word", "n").collect() if least is not None else []
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


# Characters that stand for letters, and the rows and columns of a keyboard.
LEET = str.maketrans("4@831!0$57", "aabeliosst")
WALKS = "`1234567890-= qwertyuiop[]\\ asdfghjkl;' zxcvbnm,./ 1qaz 2wsx 3edc 4rfv 5tgb 6yhn 7ujm 8ik, 9ol. 0p;/".split()
NEXT_KEY = {(a, b) for row in WALKS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d|(?:19|20)\d\d")

#: log10 of the guesses for one character by brute force, and of choosing one more part.
PER_CHAR, PER_PART = 1.0, 0.3
LONGEST_UNIT = 8


RANK = ranked([])


def _runs(holds: list[bool]) -> list[int]:
    """How many True stand in a row from each place on."""
    out, n = [0] * len(holds), 0
    for i in range(len(holds) - 1, -1, -1):
        n = n + 1 if holds[i] else 0
        out[i] = n
    return out


def _parts(value: str, rank: dict[str, int] | None = None) -> list[list[tuple[int, float]]]:
    """For each start, (end, log10 guesses) of the parts that begin there, brute force left out; some thirty at most."""
    rank = RANK if rank is None else rank
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    period = [_runs([value[i] == value[i + u] for i in range(n - u)]) + [0] * u for u in range(1, LONGEST_UNIT + 1)]
    steps = [_runs([ord(b) - ord(a) == step and b.isalnum() for a, b in zip(low, low[1:], strict=False)]) + [0] for step in (1, -1)]
    walks = _runs([pair in NEXT_KEY for pair in zip(low, low[1:], strict=False)]) + [0]
    for i in range(n):
        for j in range(i + LEAST_WORD, min(n, i + LONGEST_WORD) + 1):
            for text, extra in ((low, 0.0), (plain, math.log10(4))):
                if found := rank.get(text[i:j]):
                    case = 0.0 if value[i:j] == low[i:j] else math.log10(2)
                    out[i].append((j, math.log10(found) + extra + case))
                    break
        if m := DATE.match(value, i):
            out[i].append((m.end(), math.log10(365 * 120 if m.end() - i > 4 else 120)))
        for unit, run in enumerate(period, 1):
            times = 1 + run[i] // unit
            if times >= (3 if unit == 1 else 2):
                out[i].append((i + unit * times, unit * PER_CHAR + math.log10(times)))
        for run in steps:
            if run[i] >= 2:
                out[i].append((i + run[i] + 1, math.log10(26 * (run[i] + 1))))
        if walks[i] >= 2:
            out[i].append((i + walks[i] + 1, math.log10(47 * (walks[i] + 1)) + math.log10(2)))
    return out


def guess_cost(value: str, rank: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``; 0 for an empty one. Linear in its length."""
    n = len(value)
    # Cheapest with the last part a known one, and with a brute-force span still open.
    known, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)
    known[0] = 0.0
    parts = _parts(value, rank)
    for i in range(n):
        best = min(known[i], brute[i])
        brute[i + 1] = min(brute[i + 1], brute[i] + PER_CHAR, known[i] + PER_PART + PER_CHAR)
        for j, cost in parts[i]:
            known[j] = min(known[j], best + PER_PART + cost)
    return min(known[n], brute[n])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in ``text``, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, rank: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    found = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?")
        if len(value) >= 6 and guess_cost(value, rank) >= MIN_GUESSES_LOG10:
            found.append((m.start(1), 3, m.start(1) + len(value)))
    return found


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _run(batches: Iterator[pa.RecordBatch], rank: dict[str, int]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        n = len(texts)
        counts, sums, spans = [[0] * n for _ in range(4)], [none] * n, [""] * n
        worth = pc.indices_nonzero(pc.match_substring_regex(texts, MAYBE))
        for i, text in zip(worth.to_pylist(), texts.take(worth), strict=True):
            text = text.as_py()
            base = base_spans(text)
            for _, k, _ in base:
                counts[k][i] += 1
            more = guess_spans(text, rank)
            counts[3][i] = len(more)
            sums[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))
        arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(sums), pa.array(spans)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])


def _sent(documents: DataFrame, words: list[str] | None):
    """The dictionary as a broadcast of bounded size: ``words``, or those of the corpus."""
    return documents.sparkSession.sparkContext.broadcast(ranked(common_words(documents) if words is None else words))


def scan(documents: DataFrame, words: list[str] | None = None) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    Offsets are code points, ends exclusive. ``words`` stand in the dictionary in place of the corpus's own. A null text is
    empty and has no spans. Repeated rows are scanned each; other columns are ignored; an empty table gives no rows.
    """
    sent = _sent(documents, words)
    kinds = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return documents.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(bw.handing_back(lambda batches: _run(batches, sent.value)), kinds)


def mask(text: str, rank: dict[str, int] | None = None) -> str:
    """``text`` with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    out, at = [], 0
    for start, kind, end in sorted(base_spans(text) + guess_spans(text, rank)):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _mask(batches: Iterator[pa.RecordBatch], rank: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in bw.blocks(batches, limit=MASK_BYTES):
        texts = batch.column(batch.schema.get_field_index("text"))
        worth = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False)
        made = pa.array([mask(t.as_py(), rank) for t in texts.filter(worth)], texts.type)
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pc.replace_with_mask(texts, worth, made)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def masked(documents: DataFrame, words: list[str] | None = None) -> DataFrame:
    """``documents`` with all columns, secrets in ``text`` masked and ``n_chars``, if there, counted anew; a null text stays
    null, with the n_chars it has. ``words`` as for ``scan``."""
    sent = _sent(documents, words)
    out = documents.mapInArrow(bw.handing_back(lambda batches: _mask(batches, sent.value)), documents.schema)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, with the words of ``documents`` in the dictionary."""
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
#: SQL has no positions of regex matches and no such segmentation; tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
