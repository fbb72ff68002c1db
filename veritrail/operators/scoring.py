"""Verdicts, judges and the summaries of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens

VERDICTS = ("true_pass", "lucky_pass", "generation_failure", "retrieval_failure")
FAILURE_CLASSES = ("pass", "retrieval_miss", "generation_miss")
GROUNDED_SHARE = 0.8
HEALTHY_SHARE = 0.8


def verdict(hit: Column, correct: Column) -> Column:
    return F.when(hit & correct, "true_pass").when(~hit & correct, "lucky_pass").when(hit & ~correct, "generation_failure").otherwise("retrieval_failure")


def failure_class(hit: Column, correct: Column) -> Column:
    """A lucky pass counts as a miss of retrieval."""
    return F.when(~hit, "retrieval_miss").when(correct, "pass").otherwise("generation_miss")


def judge_correct(expected: Column | str, answer: Column | str) -> Column:
    """Every part between semicolons of the expected answer has its content words in the answer."""
    have = content_tokens(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")))
    parts = F.split(F.col(expected) if isinstance(expected, str) else expected, ";")
    return F.forall(parts, lambda p: F.size(F.array_except(content_tokens(p), have)) == 0)


def judge_grounded(answer: Column | str, contexts: Column | str) -> Column:
    """Share of the answer's content words that the contexts hold, to three places; null without content words."""
    said = content_tokens(answer)
    have = content_tokens(F.array_join(F.col(contexts) if isinstance(contexts, str) else contexts, " "))
    return F.when(F.size(said) > 0, F.round(F.size(F.array_intersect(said, have)) / F.size(said), 3))


def _rate(count: Column, total: Column, digits: int = 4, scale: float = 1.0) -> Column:
    return F.when(total > 0, F.round(count * scale / total, digits)).otherwise(0.0)


def run_summary(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for a run (or for each group): counts by verdict and the rates of hits, correct answers and lucky passes.

    ``cases``: verdict, hit, is_correct, groundedness, judge_failed, confirmed. Rates of no
    cases are 0; means and confirmations of nothing are null. Halves round up.
    """
    n = F.count(F.lit(1))
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    lucky = of(F.col("verdict") == "lucky_pass")
    return cases.groupBy(*(by or [])).agg(
        n.alias("total_cases"),
        *(of(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS),
        _rate(of(F.col("hit")), n).alias("retrieval_hit_rate"),
        _rate(of(F.col("is_correct")), n).alias("answer_correctness_rate"),
        _rate(lucky, n).alias("lucky_pass_rate"),
        F.round(F.avg("groundedness"), 4).alias("mean_groundedness"),
        F.when(lucky > 0, of((F.col("verdict") == "lucky_pass") & F.col("confirmed"))).alias("ablation_confirmed_count"),
        of(F.col("judge_failed")).alias("judge_failure_count"),
    )


def eval_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score, accuracy, recall, reciprocal rank and counts of an evaluation.

    ``results``: failure_class, verdict, is_correct, recall, reciprocal_rank, judge_failed,
    adapter_error, confirmed (null: not ablated).
    """
    n = F.count(F.lit(1))
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    ablated = of((F.col("verdict") == "lucky_pass") & F.col("confirmed").isNotNull())
    return results.groupBy(*(by or [])).agg(
        n.alias("n_questions"),
        _rate(of(F.col("failure_class") == "pass"), n, 2, 100.0).alias("score"),
        _rate(of(F.col("is_correct")), n).alias("answer_accuracy"),
        _rate(F.coalesce(F.sum("recall"), F.lit(0.0)), n).alias("recall_at_k"),
        _rate(F.coalesce(F.sum("reciprocal_rank"), F.lit(0.0)), n).alias("mrr"),
        *(of(F.col("failure_class") == c).alias(f"n_{c}") for c in FAILURE_CLASSES),
        *(of(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS),
        of(F.col("judge_failed")).alias("judge_failures"),
        of(F.col("adapter_error").isNotNull()).alias("adapter_errors"),
        F.when(ablated > 0, of((F.col("verdict") == "lucky_pass") & F.col("confirmed"))).alias("lucky_pass_confirmed"),
    )


def dominant_failure(summary: DataFrame) -> DataFrame:
    """``summary`` with the commonest failure: retrieval before lucky before generation on ties; null if there is none."""
    r, lucky, g = F.col("n_retrieval_failure"), F.col("n_lucky_pass"), F.col("n_generation_failure")
    most = F.greatest(r, lucky, g)
    return summary.withColumn("dominant", F.when(most == 0, None).when(r == most, "retrieval_failure").when(lucky == most, "lucky_pass").otherwise("generation_failure"))


def headline(summary: DataFrame) -> DataFrame:
    """``summary`` with ``headline_kind, headline_count, headline_pct``: lucky passes first, else the larger failure."""
    lucky, r, g = F.col("n_lucky_pass"), F.col("n_retrieval_failure"), F.col("n_generation_failure")
    kind = F.when(lucky > 0, "lucky_pass").when((r >= g) & (r > 0), "retrieval_failure").when(g > 0, "generation_failure").otherwise("all_true_pass")
    count = F.when(lucky > 0, lucky).when((r >= g) & (r > 0), r).when(g > 0, g).otherwise(F.col("n_true_pass"))
    return summary.withColumns({"headline_kind": kind, "headline_count": count, "headline_pct": _rate(count, F.col("total_cases"), 1, 100.0)})


def plain_summary(summary: DataFrame) -> DataFrame:
    """``summary`` with ``status`` (empty, healthy, needs_work), the main ``problem`` and the ``advice`` it calls for.

    Needs ``hits`` (cases with a hit), ``match_by`` and ``any_context``.
    """
    rows = dominant_failure(summary)
    blind = (F.col("match_by") == "text") & ~F.col("any_context")
    share = F.col("n_true_pass") / F.nullif(F.col("total_cases"), F.lit(0))
    status = F.when(F.col("total_cases") == 0, "empty").when((share >= HEALTHY_SHARE) & ~blind, "healthy").otherwise("needs_work")
    problem = F.when(status == "needs_work", F.when(blind, "not_grounded").otherwise(F.coalesce("dominant", F.lit("not_grounded"))))
    advice = (
        F.when(F.col("total_cases") == 0, "write_questions")
        .when((F.col("match_by") == "id") & (F.col("hits") == 0), "match_by_text")
        .when(blind, "return_contexts")
        .otherwise(F.coalesce(F.concat(F.lit("fix_"), F.col("dominant")), F.lit("keep_checking")))
    )
    return rows.withColumns({"status": status, "problem": problem, "advice": advice})


def badge(score: Column) -> Column:
    return F.when(score >= 80, "STRONG").when(score >= 60, "GOOD").otherwise("NEEDS WORK")


def question_counts(questions: DataFrame) -> DataFrame:
    """``split, status, n`` for every split (with ``none``) and status, zeros included."""
    spark = questions.sparkSession
    grid = spark.createDataFrame([(s, t) for s in ("dev", "test", "none") for t in ("active", "stale", "rejected")], "split string, status string")
    counted = questions.groupBy(F.coalesce("split", F.lit("none")).alias("split"), "status").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counted, ["split", "status"], "left").select("split", "status", F.coalesce("n", F.lit(0)).alias("n"))


def overlap_histogram(values: DataFrame, column: str, threshold: float = 0.5) -> DataFrame:
    """``bin, n, kept``: ten bins of a tenth, the first closed, the others open below; kept up to the threshold."""
    spark = values.sparkSession
    number = F.greatest(F.ceil(F.round(F.col(column) * 10, 9)) - 1, F.lit(0)).cast("int")
    counted = values.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), ((F.col("bin") + 1) / 10 <= threshold).alias("kept"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """The middle value, the upper one of two, from counts of distinct values."""
    from pyspark.sql import Window

    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy(column))).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return running.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min(column).alias("median"))


def failure_stack(results: DataFrame, by: str) -> DataFrame:
    """Shares of pass, generation and retrieval misses by group."""
    n = F.count(F.lit(1))
    return results.groupBy(by).agg(n.alias("n"), *(F.round(F.count_if(F.col("failure_class") == c) / n, 4).alias(f"share_{c}") for c in FAILURE_CLASSES))
