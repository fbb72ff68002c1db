"""Scoring a user pipeline: every question asked once, judged, and given its verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.boundary import ablate, judge_correctness, judge_groundedness, run_adapter
from ..operators.cases import cache_lookup
from ..operators.planning import check_arguments, select_questions
from ..operators.retrieval import MATCH_THRESHOLD, recall_at_k, text_recall_at_k
from ..operators.scoring import eval_summary, failure_class, run_summary, verdict
from ..sources.tables import Store
from .scratch import cut

Maker = Callable[[], object]


def run_cases(
    questions: DataFrame, make_adapter: Maker, make_judge: Maker, k: int = 5, match_by: str = "id", chunks: DataFrame | None = None, threshold: float = MATCH_THRESHOLD, grounded: bool = True, make_alone: Maker | None = None
) -> DataFrame:
    """A scored case for every question (question_id, question, expected, chunk_ids).

    Each question goes to the pipeline once; what comes back is written before it is judged. A
    pipeline that raises gives a case that failed, with ``adapter_error``, and is not judged.
    Gold chunks are met by id or, with ``match_by="text"``, by the overlap of the contexts with the
    texts of ``chunks`` (chunk_id, text). With ``make_alone`` lucky passes are asked again
    without contexts (``confirmed``).
    """
    check_arguments(match_by, k)
    responses = cut(run_adapter(questions, make_adapter), "responses")
    rows = questions.join(responses, "question_id").withColumnRenamed("error", "adapter_error")
    if match_by == "text":
        if chunks is None:
            raise ValueError("match_by text needs the chunks of the corpus")
        rows = text_recall_at_k(rows, chunks, k, threshold)
    else:
        rows = rows.withColumns(recall_at_k(F.col("chunk_ids"), F.col("retrieved_chunk_ids"), k))
    answered = rows.where("adapter_error IS NULL")
    correct = judge_correctness(answered, make_judge).select("question_id", "is_correct", "rationale", F.col("judge_failed").alias("__c"))
    rows = rows.join(cut(correct, "correct"), "question_id", "left")
    if grounded:
        found = judge_groundedness(answered, make_judge).select("question_id", "is_grounded", F.col("score").alias("groundedness"), F.col("judge_failed").alias("__g"))
        rows = rows.join(cut(found, "grounded"), "question_id", "left")
    else:
        rows = rows.withColumns({"is_grounded": F.lit(None).cast("boolean"), "groundedness": F.lit(None).cast("double"), "__g": F.lit(False)})
    right = F.coalesce("is_correct", F.lit(False))
    rows = rows.withColumns({"is_correct": right, "judge_failed": F.coalesce("__c", F.lit(False)) | F.coalesce("__g", F.lit(False))}).drop("__c", "__g")
    rows = rows.withColumns({"verdict": verdict(F.col("hit"), F.col("is_correct")), "failure_class": failure_class(F.col("hit"), F.col("is_correct"))})
    if make_alone is None:
        return rows.withColumn("confirmed", F.lit(None).cast("boolean"))
    return ablate(cut(rows, "cases"), make_alone)


def run_test_set(questions: DataFrame, make_adapter: Maker, make_judge: Maker, **how) -> tuple[DataFrame, DataFrame]:
    """The scored cases, written, and their summary."""
    cases = cut(run_cases(questions, make_adapter, make_judge, **how), "cases")
    return cases, run_summary(cases)


_KEPT = ("recall", "reciprocal_rank", "hit", "is_correct", "judge_failed", "verdict", "failure_class", "confirmed", "adapter_error")


def evaluate(store: Store, questions: DataFrame, make_adapter: Maker, make_judge: Maker, config_hash: str, index_version: str, last_index: str | None = None, sample: int = 50, seed: int = 0, **how) -> tuple[str, DataFrame]:
    """The mode, and a summary over the selected questions, of which only those without a kept result are asked.

    Results are kept by question, configuration and corpus version in the store's table
    ``results``. On a new corpus version new questions and a sample of old ones are selected, on
    the same one all; see :func:`select_questions`.
    """
    empty = questions.limit(0).select("question_id", F.lit("").alias("config_hash"), F.lit("").alias("index_version"))
    results = store.read("results") if store.exists("results") else None
    own = results.where(F.col("config_hash") == config_hash) if results is not None else empty
    mode, chosen = select_questions(questions, own, last_index, index_version, sample, seed)
    chosen = cut(chosen, "chosen")
    looked = cache_lookup(chosen, results, config_hash, index_version) if results is not None else chosen.withColumn("to_run", F.lit(True))
    todo = chosen.join(looked.where("to_run").select("question_id"), "question_id", "left_semi")
    if todo.head(1):
        fresh = run_cases(todo, make_adapter, make_judge, **how).select("question_id", *_KEPT).withColumns({"config_hash": F.lit(config_hash), "index_version": F.lit(index_version)})
        store.save("results", fresh, ["question_id", "config_hash", "index_version"])
    if not store.exists("results"):
        return mode, eval_summary(todo.select(F.lit("").alias("failure_class"), F.lit("").alias("verdict"), *(F.lit(None).cast("boolean").alias(c) for c in ("is_correct", "judge_failed", "confirmed")), *(F.lit(0.0).alias(c) for c in ("recall", "reciprocal_rank")), F.lit(None).cast("string").alias("adapter_error")))
    kept = cache_lookup(chosen.select("question_id"), store.read("results"), config_hash, index_version).drop("to_run")
    return mode, eval_summary(kept)
