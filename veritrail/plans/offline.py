"""A generator without a model: facts, questions and rewrites by rules, with flaws on purpose.

It makes runs repeatable and gives the checks something to reject: about one fact in ten has a
wrong answer, and about one rewrite in nine is as close to the passage as its draft.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ids import question_id, share_threshold, split_of_all
from ..operators.planning import reject_reason
from .generate import FACTS_PER_CHUNK, OVERLAP_THRESHOLD, verify_by_rule

FLAWED_PERCENT, STUBBORN_PERCENT = 10, 11


def facts(sources: DataFrame, most: int = FACTS_PER_CHUNK) -> DataFrame:
    """``sources`` with ``fact, answer``: the first sentences that hold a value or a name."""
    said = sources.select("*", F.posexplode(X.sentences("text")).alias("__at", "fact")).withColumn("answer", X.answer_span("fact"))
    good = said.where("answer IS NOT NULL").where(X.is_usable_fact("fact", "answer"))
    first = good.withColumn("__n", F.row_number().over(Window.partitionBy("source_key").orderBy("__at"))).where(F.col("__n") <= most)
    flawed = share_threshold("fact", "flawed", FLAWED_PERCENT)
    return first.drop("__at", "__n").withColumn("answer", F.when(flawed, F.concat("answer", F.lit("9"))).otherwise(F.col("answer")))


def draft(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``draft`` question: the fact with a gap in place of its answer."""
    gap = F.replace(F.col("fact"), F.col("answer"), F.lit("what"))
    return rows.withColumn("draft", F.concat(F.regexp_replace(gap, r"[.!?\s]+$", ""), F.lit("?")))


def reword(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``question`` of every second content word of the draft; stubborn ones keep the draft."""
    words = X.content_tokens("draft")
    short = F.concat(F.lit("What about "), F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " "), F.lit("?"))
    return rows.withColumn("question", F.when(share_threshold("draft", "stubborn", STUBBORN_PERCENT) | (F.size(words) < 4), F.col("draft")).otherwise(short))


def questions(sources: DataFrame, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """Checked questions from ``source_key, chunk_ids, chunk_hashes, text``, active or rejected with a reason."""
    rows = reword(draft(facts(sources)))
    rows = rows.withColumns({"question_id": question_id("chunk_hashes", "fact"), "split": split_of_all("chunk_ids"), "overlap": F.round(X.lexical_overlap("question", "text"), 4)})
    done = reject_reason(verify_by_rule(rows), threshold)
    return done.select("question_id", "source_key", "split", "fact", "question", F.col("answer").alias("gold_answer"), F.col("overlap").alias("lexical_overlap"), F.when(F.col("reject_reason").isNull(), "active").otherwise("rejected").alias("status"), "reject_reason")
