"""The audit of a retrieval pipeline over a corpus: from documents to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import hash_content, share_threshold, stable_chunk_id
from ..functions.text import tokens_alnum
from ..operators.chunking import chunk_fixed
from ..operators.ordering import numbered
from ..operators.retrieval import degrade, match_contexts, retrieve
from ..operators.scoring import failure_class, judge_correct, verdict
from .scratch import cut

ANSWER_WORDS, K = 6, 5
CLOSED_BOOK_PERCENT, DEGRADED_PERCENT = 25, 30


def corpus_chunks(docs: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, position, text, hash`` of ``doc_id, text`` documents."""
    chunks = chunk_fixed(docs.select("doc_id", "text"))
    return chunks.select(stable_chunk_id("doc_id", "position").alias("chunk_id"), "doc_id", F.col("position").cast("bigint").alias("position"), "text", hash_content("text").alias("hash"))


def cloze_questions(items: DataFrame) -> DataFrame:
    """``query_id, text, expected, gold``: a passage without its last words asks for them."""
    t = tokens_alnum("text")
    n = F.size("t")
    rows = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("gold"), t.alias("t")).where(n > ANSWER_WORDS)
    return rows.select("query_id", F.array_join(F.slice("t", F.lit(1), n - ANSWER_WORDS), " ").alias("text"), F.array_join(F.slice("t", n - ANSWER_WORDS + 1, F.lit(ANSWER_WORDS)), " ").alias("expected"), "gold")


def audit_cases(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per question: what was retrieved, whether it was right, and whether it was earned.

    A lexical retriever answers with its best passage. To show all verdicts, some questions get
    other passages and some are answered from memory, both chosen by a hash of the question.
    """
    chunks = corpus_chunks(docs)
    questions = cloze_questions(items)
    ids = numbered(chunks.select("chunk_id", "doc_id", "position"), ["doc_id", "position"])
    ranked = cut(degrade(retrieve(chunks, questions, K), ids, DEGRADED_PERCENT), "ranked")
    contexts = ranked.join(chunks.select("chunk_id", "text"), "chunk_id")
    found = match_contexts(contexts.select("query_id", "rank", "text"), questions.select("query_id", F.col("gold").alias("text")))
    best = contexts.where("rank = 1").select("query_id", F.col("text").alias("best"), F.col("chunk_id").alias("best_chunk"))
    rows = questions.join(found, "query_id", "left").join(best, "query_id", "left")
    memory = share_threshold(F.col("query_id").cast("string"), "memory", CLOSED_BOOK_PERCENT)
    rows = rows.withColumn("answer", F.when(memory, F.col("expected")).otherwise(F.coalesce("best", F.lit(""))))
    hit, correct = F.col("match_rank").isNotNull(), judge_correct("expected", "answer")
    rows = rows.withColumns({"hit": hit, "is_correct": correct})
    return rows.select(
        "query_id", "best_chunk", F.col("match_rank").cast("bigint").alias("match_rank"), F.coalesce("match_score", F.lit(0.0)).alias("match_score"), "hit", "is_correct",
        verdict(F.col("hit"), F.col("is_correct")).alias("verdict"), failure_class(F.col("hit"), F.col("is_correct")).alias("failure_class"),
    )
