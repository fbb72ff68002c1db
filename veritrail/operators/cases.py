"""Scored cases and the tables around them: joins, look-ups, sets, and what a report says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column, highlight
from .scoring import VERDICTS

NO_QUESTION = "(no such question)"
SMALL_SAMPLE = 20
EXAMPLES, FEEDBACK, LAST_TRIALS = 3, 5, 8

LABELS = dict(zip(VERDICTS, ("True pass", "Lucky pass", "Generation failure", "Retrieval failure")))
#: What to try for a case that failed.
TRIES = {
    "generation_failure": ("Ask for an answer to just this question", "Ask for answers from the passage alone", "Send fewer or shorter passages"),
    "retrieval_failure": ("Retrieve more passages", "Use smaller chunks, or add keyword search", "See whether the page is in the index"),
    "lucky_pass": ("Mend retrieval first: the page should come back", "Ask for answers from the context alone", "Retrieve more passages, or rank them again"),
}


# --- joins -------------------------------------------------------------------------------


def join_required(rows: DataFrame, table: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``rows`` with the columns of ``table``; a row without a match ends the job, and the error names it."""
    found = "__found"
    both = rows.join(table.withColumn(found, F.lit(True)), keys, "left")
    problem = F.concat(F.lit(f"no {what} for "), F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)))
    return both.where(F.when(F.col(found), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))).drop(found)


def cases_with_questions(cases: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Every case with its question; a case without one is an error."""
    return join_required(cases, questions, [key], "question")


def cases_or_placeholder(cases: DataFrame, questions: DataFrame, key: str = "question_id", text: str = "question", placeholder: str | float = NO_QUESTION) -> DataFrame:
    """Every case; ``text`` of a case without a question is a placeholder."""
    return cases.join(questions, key, "left").withColumn(text, F.coalesce(text, F.lit(placeholder)))


def results_of_questions(results: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """The results whose question is there, with its columns."""
    return results.join(questions, key)


def gold_texts(questions: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``questions`` with the text of their gold chunk; a chunk that isn't in the corpus is an error."""
    return join_required(questions, chunks.select(key, "text"), [key], "chunk")


def shared_questions(outcomes: DataFrame, previous: DataFrame) -> DataFrame:
    """``run_id, shared``: questions that a run (``run_id, prev_run_id``) and the run before it have in common."""
    own = outcomes.select("run_id", "question_id").distinct()
    then = own.select(F.col("run_id").alias("prev_run_id"), "question_id")
    both = own.join(previous.select("run_id", "prev_run_id"), "run_id").join(then, ["prev_run_id", "question_id"])
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("shared"))


def cache_lookup(questions: DataFrame, results: DataFrame, config_hash: str, index_version: str) -> DataFrame:
    """``questions`` with the result that is kept of each for this configuration and corpus, and ``to_run`` where there is none."""
    kept = results.where((F.col("config_hash") == config_hash) & (F.col("index_version") == index_version)).drop("config_hash", "index_version")
    return questions.join(kept.withColumn("__kept", F.lit(True)), "question_id", "left").withColumn("to_run", F.col("__kept").isNull()).drop("__kept")


# --- sets and counts ---------------------------------------------------------------------


def union_done_keys(*tables: DataFrame, key: str = "source_key") -> DataFrame:
    """The keys of all tables, each once."""
    keys = tables[0].select(key)
    for t in tables[1:]:
        keys = keys.unionByName(t.select(key))
    return keys.distinct()


def id_sets(before: DataFrame, after: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``side, key``: ids that are new, deleted, or on both sides."""
    sides = before.select(key, F.lit(1).alias("__s")).unionByName(after.select(key, F.lit(2).alias("__s")))
    held = sides.groupBy(key).agg(F.max(F.col("__s") == 1).alias("old"), F.max(F.col("__s") == 2).alias("new"))
    return held.select(F.when(~F.col("old"), "new").when(~F.col("new"), "deleted").otherwise("both").alias("side"), key)


def reason_rank(rejected: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """``reason, n, place``: the commonest first, then by name. There are as many rows as reasons."""
    counted = rejected.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "reason")))


def source_counts(trials: DataFrame, source: str = "source") -> DataFrame:
    """Trials by who proposed them."""
    return trials.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def distinct_ids(results: DataFrame, config_hash: str, split: str) -> DataFrame:
    """Ids of the questions with any result of a configuration and split."""
    return results.where((F.col("config_hash") == config_hash) & (F.col("split") == split)).select("question_id").distinct()


def captured_date(chunks: DataFrame, by: str, timestamp: str = "timestamp") -> DataFrame:
    """The day of the latest chunk of each source, as text."""
    return chunks.groupBy(by).agg(F.date_format(F.max(timestamp), "yyyy-MM-dd").alias("captured"))


def count_of(questions: DataFrame, split: str = "test", status: str = "active") -> DataFrame:
    """How many questions a split has; nothing of them is shown."""
    return questions.where((F.col("split") == split) & (F.col("status") == status)).agg(F.count(F.lit(1)).alias("n"))


def first_of_each(rows: DataFrame, by: str, order: list[str], n: int = EXAMPLES) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def feedback(trials: DataFrame, failed: DataFrame, n: int = FEEDBACK) -> DataFrame:
    """Of each search's best trial (score, then the earliest) the first ``n`` failed cases by question id."""
    best = trials.groupBy("tune_id").agg(F.max_by("trial_index", F.struct("score", -F.col("trial_index"))).alias("trial_index"))
    return first_of_each(failed.join(best, ["tune_id", "trial_index"], "left_semi"), "tune_id", ["question_id"], n)


def ordered(table: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``table`` with the place of each row, from 1, in its group: the order that a load by key returns."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def to_json_rows(rows: DataFrame, nested: list[str]) -> DataFrame:
    """``rows`` with columns as JSON text, nulls kept, for stores that have no nested types."""
    return rows.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in nested})


def from_json_rows(rows: DataFrame, schema, nested: list[str]) -> DataFrame:
    """The rows that :func:`to_json_rows` wrote; ``schema`` is that of the frame before."""
    return rows.withColumns({c: F.from_json(c, schema[c].dataType) for c in nested})


# --- views of a report ---------------------------------------------------------------------


def why(verdict: Column | str, rank: Column | str, rationale: Column | str, confirmed: Column | str, error: Column | str) -> Column:
    """One sentence or two on how a case came to its verdict, and what the judge said of a failure."""
    v, r, ok = column(verdict), column(rank), column(confirmed)
    base = (
        F.when(v == "generation_failure", F.when(r.isNull(), "The right passage was there, and the answer was still wrong.").otherwise(F.concat(F.lit("The right passage came back at place "), r.cast("string"), F.lit(", and the answer was still wrong: look at the prompt or the model."))))
        .when(v == "retrieval_failure", "The passage with the answer did not come back, and the answer was wrong.")
        .when(
            v == "lucky_pass",
            F.concat(
                F.lit("The answer was right, though the passage that holds it did not come back."),
                F.when(ok, " Asked again without passages it was right once more: it came from memory.").when(~ok, " Asked again without passages it was wrong: another passage may have helped.").otherwise(""),
            ),
        )
        .otherwise("The right passage, and the right answer.")
    )
    said = F.when(column(rationale).isNotNull() & (v != "true_pass"), F.concat(F.lit(" Judge: "), column(rationale))).otherwise("")
    return F.when(column(error).isNotNull(), F.concat(F.lit("The pipeline raised an error, which counts as a failure: "), column(error))).otherwise(F.concat(base, said))


def tries(verdict: Column | str) -> Column:
    """Up to three things to try; none for a true pass."""
    out = F.array().cast("array<string>")
    for v, texts in TRIES.items():
        out = F.when(column(verdict) == v, F.array(*map(F.lit, texts))).otherwise(out)
    return out


def explain_cases(cases: DataFrame) -> DataFrame:
    """``cases`` with ``label, rank_text, why, tries, passages`` (n, html, source) and ``gold_html`` (of missed passages).

    Reads verdict, hit, rank (from 1, or null), contexts, expected, gold_text, rationale, confirmed
    and error. The answer is marked in the passage that holds it, and in the gold passage.
    """
    own = lambda i: F.col("hit") & F.col("rank").eqNullSafe(i + 1)
    passage = lambda text, i: F.struct((i + 1).alias("n"), highlight(text, F.when(own(i), F.col("expected")).otherwise("")).alias("html"), F.coalesce(own(i), F.lit(False)).alias("source"))
    label = F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), F.col("verdict"))
    return cases.withColumns(
        {
            "label": label,
            "rank_text": F.coalesce(F.concat(F.lit("#"), F.col("rank").cast("string")), F.lit("–")),
            "why": why("verdict", "rank", "rationale", "confirmed", "error"),
            "tries": tries("verdict"),
            "passages": F.transform("contexts", passage),
            "gold_html": F.when(~F.col("hit") & F.col("gold_text").isNotNull(), highlight("gold_text", "expected")),
        }
    )


def stat_cards(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, percentages (whole for the cards, one digit for the ring's share) and the ring's text of each run."""
    n, of = F.count(F.lit(1)), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    correct = of(F.col("is_correct"))
    pct = lambda c: F.round(c * 100.0 / n, 1)
    return cases.groupBy(*(by or [])).agg(
        n.alias("n"),
        of(F.col("hit")).alias("hits"),
        correct.alias("correct"),
        of(F.col("verdict") == "lucky_pass").alias("lucky"),
        pct(of(F.col("hit"))).alias("hit_pct"),
        pct(correct).alias("correct_pct"),
        pct(of(F.col("verdict") == "true_pass")).alias("ring"),
        F.concat(of(F.col("verdict") == "true_pass").cast("string"), F.lit("/"), n.cast("string")).alias("ring_text"),
        F.round(F.avg("groundedness") * 100, 1).alias("grounded_pct"),
        of(F.col("judge_failed")).alias("judge_failures"),
    )


def bullets(cards: DataFrame) -> DataFrame:
    """``cards`` of :func:`stat_cards` with up to three sentences that say how to read them."""
    first = (
        F.when(F.col("hit_pct") > F.col("correct_pct"), "More hits than right answers: what went wrong came after the search.")
        .when(F.col("hit_pct") < F.col("correct_pct"), "More right answers than hits: some did not come from the right page.")
        .otherwise("As many hits as right answers: where the page was found, the answer followed.")
    )
    second = F.when(F.col("lucky") == 0, "No lucky passes: right answers came from the documents.").otherwise(F.concat(F.lit("Lucky passes, which the search did not earn: "), F.col("lucky").cast("string")))
    third = F.when(F.col("n") < SMALL_SAMPLE, F.concat(F.lit("A small sample: "), F.col("n").cast("string"))).when(F.col("judge_failures") > 0, F.concat(F.lit("Replies of the judge that could not be read: "), F.col("judge_failures").cast("string")))
    said = F.filter(F.array(first, second, third), lambda s: s.isNotNull())
    return cards.withColumn("bullets", F.when(F.col("n") > 0, said).otherwise(F.array().cast("array<string>")))


def loop_view(trials: DataFrame, last: int | None = LAST_TRIALS) -> DataFrame:
    """The last trials of each search, or all where ``last`` is None, with their place ``x`` from 1, left to right."""
    if last is not None:
        trials = trials.withColumn("__n", F.row_number().over(Window.partitionBy("tune_id").orderBy(F.desc("trial_index")))).where(F.col("__n") <= last).drop("__n")
    return ordered(trials, ["tune_id"], ["trial_index"], "x")


def tune_extra(trials: DataFrame) -> DataFrame:
    """``tune_id, best, n_trials, baseline``: a finished search in one row, for the history."""
    baseline = F.max(F.when(F.col("trial_index") == 0, F.col("score"))).alias("baseline")
    return trials.groupBy("tune_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n_trials"), baseline)
