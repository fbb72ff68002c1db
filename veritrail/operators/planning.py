"""What to run and what to write: question selection, spreading, pools, budgets, grids."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import split_of
from .ordering import numbered, running_sum

REGRESSION_SAMPLE = 50
MAX_RANGE_VALUES = 1000
#: Chunks of a corpus among which similar ones are paired at most.
MOST_SIMILAR = 2000


def spread(chunks: DataFrame, questions: int, order: list[str]) -> DataFrame:
    """``chunks`` that get questions, with ``n_questions``: evenly spaced ones, or all and more of the first.

    Needs a running number over the corpus; the number is made in the order of ``order``.
    """
    total = chunks.agg(F.count(F.lit(1)).alias("__n"))
    q = F.lit(max(0, questions))
    rows = numbered(chunks, order, "__i").crossJoin(F.broadcast(total))
    # Of q evenly spaced ones, chunk i is taken if some j < q has floor(j n / q) = i.
    taken = F.ceil(F.col("__i") * q / F.col("__n")) * F.col("__n") < (F.col("__i") + 1) * q
    many = F.floor(q / F.col("__n")) + F.when(F.col("__i") < q % F.col("__n"), 1).otherwise(0)
    n = F.when(q <= F.col("__n"), F.when(taken & (F.ceil(F.col("__i") * q / F.col("__n")) < q), 1).otherwise(0)).otherwise(many)
    return rows.withColumn("n_questions", n.cast("bigint")).where("n_questions > 0").drop("__i", "__n")


def pending_sources(sources: DataFrame, active: DataFrame, attempted: DataFrame) -> DataFrame:
    """Sources (source_key) that have neither an active question nor an attempt."""
    return sources.join(active.select("source_key").union(attempted.select("source_key")).distinct(), "source_key", "left_anti")


def regression_sample(old: DataFrame, n: int, seed: int, index_version: str) -> DataFrame:
    """n of the questions, chosen by a salted hash: repeatable, and anew for every corpus version."""
    order = F.sha2(F.concat(F.lit(f"{seed}:{index_version}:"), F.col("question_id")), 256)
    return old.orderBy(order, "question_id").limit(n)


def select_questions(questions: DataFrame, results: DataFrame, last_index: str | None, index_version: str, sample: int = REGRESSION_SAMPLE, seed: int = 0) -> tuple[str, DataFrame]:
    """The mode, and the questions with ``is_new``: all (full, cached), or new ones and a sample of old ones.

    ``results``: question ids with any result of this configuration and split. ``last_index``
    is the corpus version of its last run, None if there was none.
    """
    seen = results.select("question_id").distinct().withColumn("__seen", F.lit(True))
    marked = questions.join(seen, "question_id", "left").withColumn("is_new", F.col("__seen").isNull()).drop("__seen")
    if last_index is None:
        return "full", marked.withColumn("is_new", F.lit(True))
    if last_index == index_version:
        return "cached", marked
    old = regression_sample(marked.where(~F.col("is_new")), sample, seed, index_version)
    return "regression", marked.where("is_new").unionByName(old)


def plan_pool(pool: DataFrame, before: DataFrame, after: DataFrame, fresh: bool = False, target: int | None = None, last_target: int | None = None) -> DataFrame:
    """``pool`` (question_key, chunk_id, chunk_hash) with ``action``: reuse, or retire as changed, deleted or fresh.

    All questions retire as fresh if that is asked for, or if another number of questions is wanted than last time.
    """
    if fresh or (target is not None and last_target is not None and target != last_target):
        return pool.withColumn("action", F.lit("fresh"))
    current = after.select("chunk_id", F.col("hash").alias("__now"))
    action = F.when(F.col("__now").isNull(), "deleted").when(F.col("__now") == F.col("chunk_hash"), "reuse").otherwise("changed")
    return pool.join(current, "chunk_id", "left").withColumn("action", action).drop("__now")


def chunks_to_write(pool: DataFrame, before: DataFrame, after: DataFrame, target: int) -> DataFrame:
    """``chunk_id, n_questions``: as many for a changed chunk as it loses, and the set's density for new chunks."""
    changed = plan_pool(pool, before, after).where("action = 'changed'").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_questions"))
    new = after.join(before.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")
    sizes = new.agg(F.count(F.lit(1)).alias("__new")).crossJoin(after.agg(F.count(F.lit(1)).alias("__all")))
    share = F.greatest(F.lit(1), F.round(F.lit(float(target)) * F.col("__new") / F.col("__all"))).cast("bigint")
    rows = numbered(new, ["chunk_id"], "__i").crossJoin(F.broadcast(sizes)).withColumn("__q", share)
    first = F.ceil(F.col("__i") * F.col("__q") / F.col("__new"))
    few = F.when((first * F.col("__new") < (F.col("__i") + 1) * F.col("__q")) & (first < F.col("__q")), 1).otherwise(0)
    many = F.floor(F.col("__q") / F.col("__new")) + F.when(F.col("__i") < F.col("__q") % F.col("__new"), 1).otherwise(0)
    spread_new = rows.withColumn("n_questions", F.when(F.col("__q") <= F.col("__new"), few).otherwise(many).cast("bigint")).where("n_questions > 0").select("chunk_id", "n_questions")
    return changed.unionByName(spread_new)


def plan_generation(chunks: DataFrame, covered: DataFrame, before: DataFrame) -> DataFrame:
    """``chunk_id, priority`` of all chunks: changed ones with questions, new ones, other uncovered ones, current ones."""
    have = covered.select("chunk_id").distinct().withColumn("__covered", F.lit(True))
    old = before.select("chunk_id", F.col("hash").alias("__old"))
    rows = chunks.select("chunk_id", "hash").join(have, "chunk_id", "left").join(old, "chunk_id", "left")
    is_covered, changed = F.coalesce("__covered", F.lit(False)), F.col("__old").isNotNull() & (F.col("__old") != F.col("hash"))
    priority = F.when(is_covered & changed, 0).when(F.col("__old").isNull(), 1).when(~is_covered, 2).otherwise(3)
    return rows.select("chunk_id", priority.alias("priority"))


def within_budget(work: DataFrame, cap: int, order: list[str], cost: str = "cost") -> DataFrame:
    """The first rows whose summed cost stays within the cap; a row that would pass it ends the work."""
    return running_sum(work, order, cost, "spent").where(F.col("spent") <= cap)


MATCH_BY = ("id", "text")
MOST_QUESTIONS = 500


def check_arguments(match_by: str = "id", k: int = 5, questions: int = 20, budget: int | None = None) -> None:
    """ValueError for a match mode that there isn't, k or a budget below 1, or a number of questions outside 1 to 500."""
    if match_by not in MATCH_BY:
        raise ValueError(f"match_by must be one of {', '.join(MATCH_BY)}, not {match_by!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if not 1 <= questions <= MOST_QUESTIONS:
        raise ValueError(f"questions must be from 1 to {MOST_QUESTIONS}")
    if budget is not None and budget < 1:
        raise ValueError("the budget must be at least 1 call")


def check_cost(generated_chunks: int, questions: int) -> tuple[int, int]:
    """Model calls of a check: least, and most if every case is asked again without context."""
    least = generated_chunks + 2 * questions
    return least, least + 2 * questions


def improve_cost(passages: int, trials: int, budget: int, floor: int = 1) -> dict[str, int]:
    """Calls for writing and searching, with passages reduced until the total fits the budget or the floor."""
    while True:
        writing = 8 * passages
        questions = math.ceil(1.2 * passages)
        searching = 2 * questions * (trials + 2)
        if writing + searching <= budget or passages <= floor:
            return {"passages": passages, "writing_calls": writing, "search_calls": searching, "total_calls": writing + searching}
        passages -= 1


def knob_values(spec: list | dict) -> list:
    """The values of a knob: a list without repeats, or a range with ends included, ten decimals, at most 1000 values."""
    if isinstance(spec, list):
        if not spec:
            raise ValueError("a knob needs a value")
        return [v for i, v in enumerate(spec) if v not in spec[:i]]
    low, high, step = spec["min"], spec["max"], spec["step"]
    if step <= 0 or high < low:
        raise ValueError("a range needs min <= max and a positive step")
    count = int(math.floor((high - low) / step + 1e-9)) + 1
    if count > MAX_RANGE_VALUES:
        raise ValueError(f"a range of over {MAX_RANGE_VALUES} values")
    values = [round(low + i * step, 10) for i in range(count)]
    return [int(v) for v in values] if all(isinstance(x, int) for x in (low, high, step)) else values


def grid(spark: SparkSession, knobs: dict[str, list | dict]) -> DataFrame:
    """``config_index`` and a column a knob for all combinations; the first knob changes slowest."""
    values = {name: knob_values(spec) for name, spec in knobs.items()}
    rows = [(i, *map(str, combination)) for i, combination in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, ", ".join(["config_index bigint", *(f"`{name}` string" for name in values)]))


def random_order(configs: DataFrame, seed: int) -> DataFrame:
    """``configs`` with ``trial_order`` from 0, by a salted hash of the settings; never repeats one."""
    names = [c for c in configs.columns if c != "config_index"]
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), *names), 256)
    return configs.withColumn("trial_order", F.row_number().over(Window.orderBy(key, *names)) - 1)


def candidate_pairs(chunks: DataFrame, tokens: str = "tokens", least: float = 0.15, similar: bool | None = None, salt: str | None = None) -> DataFrame:
    """``chunk_a, chunk_b, score`` for questions over two chunks of one split, best first.

    Neighbours in a document score 1 + similarity; chunks of different documents whose word
    sets reach ``least`` in Jaccard score that. The latter come from an inverted list of words
    and are sought among at most ``MOST_SIMILAR`` chunks, the rule of this operator, unless
    ``similar`` says otherwise.
    """
    from ..functions.text import jaccard

    split = split_of("chunk_id", salt) if salt else split_of("chunk_id")
    rows = chunks.select("chunk_id", "doc_id", "position", F.col(tokens).alias("t"), split.alias("split"))
    order = Window.partitionBy("doc_id").orderBy("position")
    ahead = rows.withColumns({c + "_b": F.lead(c).over(order) for c in ("chunk_id", "t", "split")}).where("chunk_id_b IS NOT NULL")
    near = ahead.where("split = split_b").select(F.col("chunk_id").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b"), F.round(1 + jaccard(F.col("t"), F.col("t_b")), 6).alias("score"))
    if similar is None:
        similar = chunks.limit(MOST_SIMILAR + 1).count() <= MOST_SIMILAR
    if not similar:
        return near
    words = rows.select("chunk_id", "doc_id", "split", F.size("t").alias("n"), F.explode("t").alias("word"))
    other = words.select(*(F.col(c).alias(c + "_b") for c in ("chunk_id", "doc_id", "split", "n")), "word")
    shared = words.join(other, "word").where("chunk_id < chunk_id_b AND doc_id <> doc_id_b AND split = split_b")
    scored = shared.groupBy("chunk_id", "chunk_id_b", "n", "n_b").agg(F.count(F.lit(1)).alias("c")).withColumn("score", F.col("c") / (F.col("n") + F.col("n_b") - F.col("c")))
    far = scored.where(F.col("score") >= least).select(F.col("chunk_id").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b"), F.round("score", 6).alias("score"))
    return near.unionByName(far)


def reject_reason(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``rows`` with the first reason to reject a question, or null.

    Reads split, overlap, question, and what a verifier said: supported, answerable,
    unambiguous (all null if its reply could not be read).
    """
    from ..functions.text import relative_time

    reason = (
        F.when(F.col("split").isNull(), "cross_split")
        .when(F.col("overlap") > threshold, "too_lexical")
        .when(relative_time("question").isNotNull(), "relative_time")
        .when(F.col("supported").isNull() | F.col("answerable").isNull() | F.col("unambiguous").isNull(), "verifier_unparseable")
        .when(~F.col("supported"), "unsupported")
        .when(~F.col("answerable"), "unanswerable")
        .when(~F.col("unambiguous"), "ambiguous")
    )
    return rows.withColumn("reject_reason", reason)
