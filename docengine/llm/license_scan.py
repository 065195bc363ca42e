"""License scans by ordered signature rules.

Rules are regular expressions over the lower-cased text, made from license families, their versions and a few shapes of
notice (identifier tags, full names with a version, grants, addresses, abbreviations, bare names). A rule is tried only
where its two keywords occur, and only texts with a first keyword of any rule get that far; for abbreviations, which occur
in many words, a mark that stands for one by itself is the keyword. Every match is an interval with the rule's
priority; one that lies inside the interval of a match of higher priority, or inside a longer one of its own priority,
is suppressed. What is left gives labels and a score, the weight of the strongest rule.

Beside these the four base phrases are located as words. All of it is one projection of a scan: no shuffle.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.spill import table

# The words of a text, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Family label, its name as a pattern, its abbreviation as a pattern, an address pattern, and versions.
FAMILIES = (
    ("gpl", r"gnu general public licen[sc]e", "gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e", "lgpl", r"gnu\.org/licenses/(?:old-licenses/)?lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", r"gnu affero general public licen[sc]e", "agpl", r"gnu\.org/licenses/agpl", ("1.0", "3.0")),
    ("gfdl", r"gnu free documentation licen[sc]e", "gfdl", r"gnu\.org/licenses/(?:old-licenses/)?fdl", ("1.1", "1.2", "1.3")),
    ("apache", r"apache (?:software )?licen[sc]e", "apache", r"apache\.org/licenses/license", ("1.0", "1.1", "2.0")),
    ("mit", r"mit(?:/x11)? licen[sc]e", "mit", r"opensource\.org/licenses/mit", ()),
    ("isc", r"isc licen[sc]e", "isc", r"opensource\.org/licenses/isc", ()),
    ("mpl", r"mozilla public licen[sc]e", "mpl", r"mozilla\.org/(?:en-us/)?mpl", ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public licen[sc]e", "epl", r"eclipse\.org/legal/epl", ("1.0", "2.0")),
    ("cddl", r"common development and distribution licen[sc]e", "cddl", r"opensource\.org/licenses/cddl", ("1.0", "1.1")),
    ("cpl", r"common public licen[sc]e", "cpl", r"opensource\.org/licenses/cpl", ("1.0",)),
    ("eupl", r"european union public licen[sc]e", "eupl", r"eupl\.eu", ("1.0", "1.1", "1.2")),
    ("osl", r"open software licen[sc]e", "osl", r"opensource\.org/licenses/osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", r"academic free licen[sc]e", "afl", r"opensource\.org/licenses/afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", r"artistic licen[sc]e", "artistic", r"opensource\.org/licenses/artistic", ("1.0", "2.0")),
    ("bsl", r"boost software licen[sc]e", "bsl", r"boost\.org/license", ("1.0",)),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib", r"opensource\.org/licenses/zlib", ()),
    ("unlicense", r"the unlicense", "unlicense", r"unlicense\.org", ()),
    ("wtfpl", r"do what the f\w+ you want to public licen[sc]e", "wtfpl", r"wtfpl\.net", ("2.0",)),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", "odbl", r"opendatacommons\.org/licenses/odbl", ("1.0",)),
    ("ofl", r"(?:sil )?open font licen[sc]e", "ofl", r"scripts\.sil\.org/ofl", ("1.0", "1.1")),
    ("psf", r"python software foundation licen[sc]e", "psf", r"python\.org/psf/license", ("2.0",)),
    ("php", r"php licen[sc]e", "php", r"php\.net/license", ("3.0", "3.01")),
    ("ms-pl", r"microsoft public licen[sc]e", "ms-pl", r"opensource\.org/licenses/ms-pl", ()),
    ("bsd", r"(?:new |simplified |modified |revised )?bsd licen[sc]e", "bsd", r"opensource\.org/licenses/bsd", ()),
    ("bsd-2-clause", r"(?:bsd[ -])?(?:2|two)[ -]clause(?: bsd)? licen[sc]e", "bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause", ()),
    ("bsd-3-clause", r"(?:bsd[ -])?(?:3|three)[ -]clause(?: bsd)? licen[sc]e", "bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause", ()),
)
CC_PARTS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_NAMES = {"by": "attribution", "sa": "share ?-?alike", "nc": "non-?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Further notices, with keyword, label and weight.
NOTICES = (
    (r"all rights reserved", "rights reserved", "proprietary", 0.5),
    (r"(?:released|dedicated|placed) (?:in)?to the public domain", "public domain", "public-domain", 0.9),
    (r"permission is hereby granted, free of charge, to any person obtaining a copy", "hereby granted", "mit", 1.0),
    (r"redistribution and use in source and binary forms", "redistribution", "bsd", 1.0),
    (r"permission to use, copy, modify,? and/?(?:or)? distribute this software", "permission to use", "isc", 1.0),
    (r"this is free and unencumbered software", "unencumbered", "unlicense", 1.0),
    (r"(?:cc0|creative commons zero)(?:[ -]v?1\.0)?(?: universal)?", "c0", "cc0-1.0", 0.9),
    (r"creativecommons\.org/publicdomain/zero", "creativecommons", "cc0-1.0", 1.0),
    (r"(?:licensed|available|released|distributed) under (?:an? |the )?(?:terms of (?:an? |the )?)?[\w .,-]{3,60}?licen[sc]e", "licen", "licensed", 0.4),
)


def rules() -> list[dict]:
    """All rules in order of priority (a smaller number goes first): pattern, keyword, label, weight, priority."""
    out: list[tuple[int, str, str, str, str, float]] = []

    def add(priority: int, pattern: str, keyword: str, label: str, weight: float, also: str = "") -> None:
        spaced = pattern.replace("[ -]", r"[\s-]").replace(" ?", r"\s*").replace(" ", r"\s+")
        out.append((priority, spaced, keyword, also, label, weight))

    for label, name, short, address, versions in FAMILIES:
        plain = re.escape(short)
        own = distinctive(name)
        site = distinctive(address.split(r"\.")[0])
        add(20, rf"spdx-license-identifier: {plain}(?![\w.-])", "spdx", label, 1.0, short)
        add(30, address, re.sub(r"\\|\(.*", "", address).split("/")[0], label, 0.9, site)
        add(40, rf"(?:licensed|available|released|distributed) under (?:the )?(?:terms of (?:the )?)?{name}", "licen", label, 0.9, own)
        add(60, name, "licen", label, 0.7, own)
        for v in versions:
            exact = rf"{label}-{v}"
            digits = re.escape(v) if not v.endswith(".0") else rf"{v[0]}(?:\.0)?"
            add(10, rf"spdx-license-identifier: {plain}-{re.escape(v)}", "spdx", exact, 1.0, short)
            add(12, rf"(?:licensed|available|released|distributed) under (?:the )?(?:terms of (?:the )?)?{name}(?:,)? ?(?:version|v\.?)? ?{digits}(?![\d])", "licen", exact, 1.0, own)
            add(15, rf"{name}(?:,)? ?(?:version|v\.?)? ?{digits}(?!\d)", "licen", exact, 0.9, own)
            add(25, rf"{address}[-/v]?{digits}(?!\d)", re.sub(r"\\|\(.*", "", address).split("/")[0], exact, 1.0, site)
            add(50, rf"(?<![\w-]){plain}[ -]?v?{digits}(?![\d])", MARKED_SHORT, exact, 0.8, short)
    for parts in CC_PARTS:
        label = f"cc-{parts}"
        spoken = "[ -]".join(CC_NAMES[p] for p in parts.split("-"))
        tight = parts.replace("-", "[ -]")
        ends = r"(?![ -](?:sa|nc|nd)\b)"
        add(55, rf"(?<!\w)cc[ -]{tight}(?!\w){ends}", MARKED_CC, label, 0.8)
        add(52, rf"creative commons {spoken}(?![ -](?:share|non|no))", "creative commons", label, 0.8)
        add(30, rf"creativecommons\.org/licenses/{parts}/", "creativecommons", label, 0.9)
        for v in CC_VERSIONS:
            exact = f"{label}-{v}"
            add(10, rf"spdx-license-identifier: cc-{parts}-{re.escape(v)}", "spdx", exact, 1.0)
            add(14, rf"(?<!\w)cc[ -]{tight}[ -]v?{re.escape(v)}", MARKED_CC, exact, 1.0)
            add(14, rf"creative commons {spoken} {re.escape(v)}", "creative commons", exact, 1.0)
            add(25, rf"creativecommons\.org/licenses/{parts}/{re.escape(v)}", "creativecommons", exact, 1.0)
    for pattern, keyword, label, weight in NOTICES:
        add(70 if weight < 0.6 else 35, pattern, keyword, label, weight)
    return [dict(zip(("p", "re", "kw", "also", "label", "w"), r, strict=True)) for r in sorted(out)]


def distinctive(pattern: str) -> str:
    """A literal word that any match of the pattern holds, one of few texts if there is such a one."""
    plain = re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??|\[[^\]]*\]\??|\\.\+?|\w\?", "\n", pattern)
    words = [w for w in re.findall(r"[a-z0-9]+", plain) if len(w) > 1]
    return max(words, key=lambda w: (w not in USUAL, len(w)), default="")


# Words that many license names hold.
USUAL = {"general", "public", "licen", "license", "software", "the", "open", "free", "common", "and", "do", "you", "want", "to", "what", "union"}
#: Stand behind a text that has an abbreviation by itself before a digit, and a Creative Commons one.
MARKED_SHORT, MARKED_CC = "\x01short", "\x01cc"
SHORT_BY_ITSELF = rf"(?<![\w-])(?:{'|'.join(re.escape(f[2]) for f in FAMILIES if f[4])})[\s-]?v?\d"
CC_BY_ITSELF = r"(?<!\w)cc[\s-]by"

#: A text with none of these has no match of any rule: each rule's keyword is one of them or contains one.
GATE = ("licen", "spdx", ".org", ".eu", ".net", MARKED_SHORT, MARKED_CC, "c0", "commons", "rights reserved", "public domain", "hereby granted",
        "redistribution", "permission to use", "unencumbered")

_KIND = "array<struct<p:int,re:string,kw:string,also:string,label:string,w:double>>"
_FOUND = "struct<p:int,label:string,w:double,s:int,e:int>"


def detections(low: str, keyed: str) -> Column:
    """All matches of all rules in the column ``low``, as an array of (p, label, w, s, e); ``keyed`` is it with its marks."""
    table_ = json.dumps(rules()).replace("\\", "\\\\").replace("'", "\\'")
    every = f"""
      flatten(transform(filter(from_json('{table_}', '{_KIND}'), r -> contains({keyed}, r.kw) and contains({low}, r.also) and regexp_instr({low}, r.re) > 0), r ->
        aggregate(arrays_zip(split({low}, r.re), regexp_extract_all({low}, r.re, 0)),
          named_struct('at', 0, 'd', cast(array() as array<{_FOUND}>)),
          (acc, x) -> named_struct(
            'at', acc.at + length(x.`0`) + coalesce(length(x.`1`), 0),
            'd', if(x.`1` is null, acc.d, array_append(acc.d, named_struct('p', r.p, 'label', r.label, 'w', r.w,
              's', acc.at + length(x.`0`), 'e', acc.at + length(x.`0`) + length(x.`1`))))),
          acc -> acc.d)))"""
    return F.expr(every)


def _kept(found: str) -> Column:
    return F.expr(f"""filter({found}, x -> not exists({found}, y -> y.s <= x.s and y.e >= x.e and
        (y.p < x.p or y.p = x.p and y.e - y.s > x.e - x.s)))""")


def scan(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, found (the intervals left, in code points of the text).

    Null texts are empty: no words, no labels, score 0. Repeated rows are scanned each; other columns are ignored; an empty
    table gives no rows.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = documents.select(F.col("doc_id").cast("long"), F.translate(F.coalesce("text", F.lit("")), upper, lower).alias("low"))
    maybe = F.col("low").contains("license") | (F.col("low").contains("cc") & F.col("low").rlike(f"cc{NOT_WORD}by"))
    # Words with two spaces between them and one at either end: places of a phrase never share a space.
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", NOT_WORD, "  ")), F.lit(" "))
    counted = low.select(
        "doc_id", "low", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), F.when(maybe, spaced).alias("spaced")
    )
    n, places = lambda x: F.regexp_count(x, F.lit("[^ ]+")).cast("long"), []
    for phrase, label in PHRASES:
        cut = F.split("spaced", " " + phrase.replace(" ", "  ") + " ")
        size = len(phrase.split())
        hit = F.struct(
            F.lit(label).alias("label"),
            (F.size(cut) - 1).cast("long").alias("n"),
            n(cut[0]).alias("first"),
            (F.col("n_words") - n(F.element_at(cut, -1)) - size).alias("last"),
        )
        places.append(F.when(F.col("spaced").isNotNull() & (F.size(cut) > 1), hit))
    marks = F.concat(F.when(F.col("low").rlike(SHORT_BY_ITSELF), MARKED_SHORT).otherwise(""), F.when(F.col("low").rlike(CC_BY_ITSELF), MARKED_CC).otherwise(""))
    based = counted.select("doc_id", "low", "n_words", F.array_compact(F.array(*places)).alias("places"), F.concat("low", marks).alias("keyed"))
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.col("keyed").contains(word)
    found = based.select("doc_id", "n_words", "places", F.when(gate, detections("low", "keyed")).otherwise(F.array().cast(f"array<{_FOUND}>")).alias("every"))
    left = found.select("doc_id", "n_words", "places", _kept("every").alias("found"))
    base = "array_sort(transform(places, x -> x.label))"
    return left.selectExpr(
        "doc_id",
        "n_words",
        "aggregate(places, 0L, (acc, x) -> acc + x.n) as n_base",
        "array_min(transform(places, x -> x.first)) as first_word",
        "array_max(transform(places, x -> x.last)) as last_word",
        f"array_join({base}, ',') as base_labels",
        f"array_join(array_sort(array_union({base}, transform(found, x -> x.label))), ',') as labels",
        "coalesce(array_max(transform(found, x -> x.w)), if(size(places) > 0, 0.7D, 0D)) as score",
        "found",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, without the intervals."""
    return scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {"op6_license_scan": op6_license_scan}
#: The rules' suppression is not SQL that DuckDB shares; tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
