"""Corpus pipeline over ``documents``: language, quality, lines, near copies, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its decisions take effect.  All stages but the last return the columns
of ``documents``; the last returns the packed pieces.

Nulls: a null text has no language and goes at the first stage; a null doc_id,
source or label is carried along.  Empty tables give empty results.  Repeated
rows are documents of their own until the near copies, where one stays, as of
all that tie.  Texts of any length are worked on whole.  Extra columns are
carried along under whatever names, up to packing, which returns pieces alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard_join, language_id, line_dedup, packing, quality_rules
from quillon.llm.common import Workspace, documents, own_names, scratch, tokenizer_file

#: Predictions less sure than this count as no language: 0 is what chance among
#: the labels scores, 1 a certain one.  With four labels the score is 0.5: the
#: language must hold more of the text than all others together.
MIN_LANGUAGE_CONFIDENCE = 1 / 3


def least_score(n_labels: int) -> float:
    """The score of ``MIN_LANGUAGE_CONFIDENCE`` among so many labels."""
    chance = 1 / max(n_labels, 1)
    return chance + (1 - chance) * MIN_LANGUAGE_CONFIDENCE - 1e-9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is not recognised with confidence; a missing label takes
    the predicted one."""
    net = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    pred, score = own_names(docs, "lang_pred", "score")
    found = language_id.predict(docs, net, (pred, score))
    found = found.where((F.col(pred) != language_id.UNDETERMINED) & (F.col(score) >= least_score(len(net.labels) if net else 0)))
    return found.withColumn("lang", F.coalesce("lang", pred)).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or leave their language's band."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return quality_rules.judge(docs, docs.columns, prefix).where(f"{prefix}kept").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; ``n_chars`` follows the text."""
    (dropped,) = own_names(docs, "n_dropped")
    clean = line_dedup.dedup_lines(docs, dropped)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the least doc_id."""
    return jaccard_join.keep_one(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", keep_quality),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("packing", pack_sequences),
]

#: Trained models and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = documents(spark, sf_dir), Workspace(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:  # each stage's rows are written and read again
        with scratch():
            docs = work.table(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
