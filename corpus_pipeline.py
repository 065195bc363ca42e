"""A training-corpus pipeline: toxicity, near copies, benchmark decontamination, secrets, and mixing to target weights.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept, and returns the columns of
``documents``; the last returns what the mix takes of each document. ``run`` writes each stage's result to the shared folder and reads it
back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import decontamination, ngram_jaccard, secret_scan, source_mix, toxicity
from docengine.llm.spill import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. A document's verdict is that of its text."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.trained(docs, labels, toxicity.fold(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies. Documents without words are each a group."""
    classes = ngram_jaccard.jaccard_classes(docs)
    return ngram_jaccard.keep_one(docs, classes).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not strike."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return decontamination.judged(found).where(~F.col("contaminated")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret's span replaced by a mark of its kind; n_chars follows the text."""
    return secret_scan.masked(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: how many copies, and so many words; none of some."""
    return source_mix.mix(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
]

#: A trained model's verdicts are not SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
