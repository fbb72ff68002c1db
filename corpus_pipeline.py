"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.exact_dedup import drop_copies
from veritrail.llm.jaccard_join import keep_one_of_each
from veritrail.llm.language_id import fit, identify
from veritrail.llm.packing import pack_documents
from veritrail.llm.pii import redact_personal_data
from veritrail.llm.scratch import cut, spare, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those without a letter, and null texts, go.

    Long texts are read whole. Repeated rows, ids that repeat and null ids stay or go by their
    text alone. An empty table stays empty.
    """
    label, score = spare(docs, "lang_pred"), spare(docs, "lang_score")
    found = identify(docs, fit(docs), label_col=label, score_col=score)
    return found.where((F.col(label) != "und") | F.col("text").rlike(r"\p{L}")).drop(label, score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest id. See :func:`drop_copies` for ids that repeat or are null."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id. See :func:`keep_one_of_each` for ids that repeat or are null."""
    return keep_one_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; ``n_chars`` counts the new text. A null text stays null."""
    clean = redact_personal_data(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 4096 tokens. See :func:`pack_documents` for null texts and repeated rows."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("pii", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: Language models, shingle search, tagging and packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
