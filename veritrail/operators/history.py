"""Run histories: the run before, and changes on the questions that both runs share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_SHARED, CHART_RUNS = 10, 30
HIT_VERDICTS = ("true_pass", "generation_failure")


def _points(count: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(count * 100.0 / total, 1)).otherwise(0.0)


def previous_runs(runs: DataFrame) -> DataFrame:
    """``runs`` with ``prev_run_id, prev_fingerprint`` of the last earlier run of the same kind.

    ``runs``: run_id, kind, created_at, fingerprint. Runs of a kind are ordered by time and id.
    """
    before = Window.partitionBy("kind").orderBy("created_at", "run_id")
    return runs.withColumns({"prev_run_id": F.lag("run_id").over(before), "prev_fingerprint": F.lag("fingerprint").over(before)})


def history_delta(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a run: its own rates, and changes against the run before on shared questions only.

    ``outcomes``: run_id, question_id, verdict. Changes are differences of rounded percentages;
    null if nothing is shared. A sample is small below ten shared questions; the corpus has
    changed if both fingerprints are known and differ.
    """
    linked = previous_runs(runs)
    of = lambda v, prefix: F.count_if(F.col(prefix + "verdict").isin(*v))
    own = outcomes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_questions"), of(["true_pass"], "").alias("tp"), of(HIT_VERDICTS, "").alias("hits"), of(["lucky_pass"], "").alias("lucky_pass_count"))
    now = outcomes.join(linked.where("prev_run_id IS NOT NULL").select("run_id", "prev_run_id"), "run_id")
    then = outcomes.select(F.col("run_id").alias("prev_run_id"), "question_id", F.col("verdict").alias("old_verdict"))
    shared = now.join(then, ["prev_run_id", "question_id"]).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("shared_questions"),
        *(of(v, p).alias(name) for v, p, name in ((["true_pass"], "", "tp_now"), (["true_pass"], "old_", "tp_then"), (HIT_VERDICTS, "", "hit_now"), (HIT_VERDICTS, "old_", "hit_then"))),
    )
    rows = linked.join(own, "run_id", "left").join(shared, "run_id", "left")
    change = lambda a, b: F.round(_points(F.col(a), F.col("shared_questions")) - _points(F.col(b), F.col("shared_questions")), 1)
    n = F.coalesce("n_questions", F.lit(0))
    held = F.coalesce("shared_questions", F.lit(0))
    differs = (F.coalesce("fingerprint", F.lit("")) != "") & (F.coalesce("prev_fingerprint", F.lit("")) != "") & (F.col("fingerprint") != F.col("prev_fingerprint"))
    return rows.select(
        "run_id",
        "kind",
        "prev_run_id",
        n.alias("n_questions"),
        F.coalesce(_points(F.col("tp"), n), F.lit(0.0)).alias("true_pass_pct"),
        F.coalesce(_points(F.col("hits"), n), F.lit(0.0)).alias("retrieval_hit_pct"),
        F.coalesce("lucky_pass_count", F.lit(0)).alias("lucky_pass_count"),
        held.alias("shared_questions"),
        F.when(held > 0, change("tp_now", "tp_then")).alias("delta_true_pass"),
        F.when(held > 0, change("hit_now", "hit_then")).alias("delta_retrieval_hit"),
        (F.col("prev_run_id").isNotNull() & (held < SMALL_SHARED)).alias("small_sample"),
        differs.alias("corpus_changed"),
    )


def chart_rows(history: DataFrame, runs: int = CHART_RUNS) -> DataFrame:
    """The last runs with their number and whether they are the first of their kind.

    ``history`` holds run_id, kind, created_at. A history has a row a run; its order is total.
    """
    numbered = history.withColumns({"number": F.row_number().over(Window.orderBy("created_at", "run_id")), "first_of_kind": F.row_number().over(Window.partitionBy("kind").orderBy("created_at", "run_id")) == 1})
    last = history.agg(F.count(F.lit(1)).alias("total"))
    return numbered.crossJoin(F.broadcast(last)).where(F.col("number") > F.col("total") - runs).drop("total")


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the best practice score of each search, the earliest on ties."""
    return trials.groupBy("tune_id").agg(F.max_by(F.struct("trial_index", "score", "config"), F.struct("score", -F.col("trial_index"))).alias("t")).select("tune_id", "t.*")


def best_so_far(trials: DataFrame) -> DataFrame:
    upto = Window.partitionBy("tune_id").orderBy("trial_index").rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_so_far", F.max("score").over(upto))


def overfit_gap(best: DataFrame, threshold: float = 10.0) -> DataFrame:
    """``best`` (dev_score, test_score) with their difference in points and whether it is suspicious."""
    gap = F.round(F.col("dev_score") - F.col("test_score"), 2)
    return best.withColumns({"gap": gap, "overfit": gap > threshold})


def knob_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``knob, old, new`` of settings that differ between two ``knob, value`` tables."""
    both = before.select("knob", F.col("value").alias("old")).join(after.select("knob", F.col("value").alias("new")), "knob", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))
