"""Writing questions: staged frames, one model call a stage, cheap checks as columns in between.

Each stage's replies are written before they are used, so no plan asks a model twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import replies as R
from ..functions import text as X
from ..operators.boundary import complete
from ..operators.planning import reject_reason
from .scratch import cut

FACTS_PER_CHUNK, OVERLAP_THRESHOLD, PAIRS = 3, 0.5, 10

FACTS_PROMPT = 'List up to {n} facts that the passage states, each with a short answer it contains, as JSON: {{"facts": [{{"fact": "", "answer": ""}}]}}.'
QUESTION_PROMPT = 'Write one question, as a user would ask it, whose answer is the given one. Reply with JSON: {"question": ""}.'
REWORD_PROMPT = 'Ask the same in other words than the passage uses. Reply with JSON: {"question": ""}.'
VERIFY_PROMPT = 'Judge the question by the passage. Reply with JSON booleans: {"supported": , "answerable": , "unambiguous": }.'
TEST_PROMPT = 'Write {n} questions that only this passage answers. Reply with JSON: {{"questions": [{{"question": "", "answer": ""}}]}}.'

Client = Callable[[], object]


def _ask(rows: DataFrame, client: Client, key: str, system: str, user, name: str) -> DataFrame:
    """``rows`` with the model's ``reply``, null on an error."""
    prompts = rows.select(key, F.lit(system).alias("system"), user.alias("user"))
    return rows.join(cut(complete(prompts, client, key).select(key, "reply"), name), key)


def generate_tests(chunks: DataFrame, client: Client, per_chunk: int = 1) -> DataFrame:
    """``test_id, chunk_id, question, answer`` from one call a chunk (chunk_id, text); unreadable replies give none."""
    asked = _ask(chunks.select("chunk_id", "text"), client, "chunk_id", TEST_PROMPT.format(n=per_chunk), F.col("text"), "tests")
    items = asked.select("chunk_id", F.posexplode(F.slice(R.parse_questions("reply"), 1, per_chunk)).alias("index", "q"))
    return items.select(I.test_case_id("chunk_id", "index").alias("test_id"), "chunk_id", "q.question", "q.answer")


def generate_questions(sources: DataFrame, generator: Client, verifier: Client, facts: int = FACTS_PER_CHUNK, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """Questions from sources, active or rejected with a reason; generator and verifier should be different models.

    ``sources``: source_key, chunk_ids, chunk_hashes, text; one chunk, or two for a question
    over both. A fact is drafted into a question and reworded, twice if the wording is still
    too close to the passage; a rewrite that can't be used leaves the draft. The verifier sees
    only questions that passed the free checks, and chunks of different splits cost no more calls.
    """
    told = _ask(sources, generator, "source_key", FACTS_PROMPT.format(n=facts), F.col("text"), "facts")
    rows = told.select("source_key", "chunk_ids", "chunk_hashes", "text", F.explode(F.slice(R.parse_facts("reply"), 1, facts)).alias("f")).select("*", "f.fact", "f.answer").drop("f")
    rows = rows.withColumns({"question_id": I.question_id("chunk_hashes", "fact"), "split": I.split_of_all("chunk_ids")})
    rows = cut(rows.dropDuplicates(["question_id"]), "drafts")

    def usable(reply):
        asked = R.parse_question(reply)
        return F.when(X.question_problem(asked, F.col("text")).isNull(), asked)

    context = lambda *parts: F.concat_ws("\n", *parts, F.col("text"))
    rows = _ask(rows, generator, "question_id", QUESTION_PROMPT, context("fact", "answer"), "questions").withColumn("draft", usable("reply")).drop("reply").where("draft IS NOT NULL")
    rows = cut(rows, "drafted")
    one = rows.where("split IS NOT NULL")
    one = _ask(one, generator, "question_id", REWORD_PROMPT, context("draft"), "reworded").withColumn("question", F.coalesce(usable("reply"), "draft")).drop("reply")
    one = cut(one.withColumn("overlap", X.lexical_overlap("question", "text")), "first")
    again = _ask(one.where(F.col("overlap") > threshold), generator, "question_id", REWORD_PROMPT, context("draft", "question"), "again").select("question_id", usable("reply").alias("retry"))
    one = one.join(again, "question_id", "left").withColumn("question", F.coalesce("retry", "question")).drop("retry")
    crossed = rows.where("split IS NULL").withColumn("question", F.col("draft"))
    rows = cut(one.drop("overlap").unionByName(crossed).withColumn("overlap", F.round(X.lexical_overlap("question", "text"), 4)), "worded")

    free = rows.withColumns({"supported": F.lit(True), "answerable": F.lit(True), "unambiguous": F.lit(True)})
    paid = reject_reason(free, threshold).where("reject_reason IS NULL").drop("reject_reason", "supported", "answerable", "unambiguous")
    said = _ask(paid, verifier, "question_id", VERIFY_PROMPT, context("fact", "question", "answer"), "verified").select("question_id", R.parse_verification("reply").alias("v"))
    checked = rows.join(said, "question_id", "left").select("*", "v.supported", "v.answerable", "v.unambiguous").drop("v")
    done = reject_reason(checked, threshold)
    return done.select("question_id", "source_key", "chunk_ids", "chunk_hashes", "split", "fact", "question", F.col("answer").alias("gold_answer"), F.col("overlap").alias("lexical_overlap"), F.when(F.col("reject_reason").isNull(), "active").otherwise("rejected").alias("status"), "reject_reason")


def single_sources(chunks: DataFrame) -> DataFrame:
    """Sources of one chunk each (chunk_id, hash, text)."""
    return chunks.select(I.source_key(F.array("chunk_id"), F.array("hash")).alias("source_key"), F.array("chunk_id").alias("chunk_ids"), F.array("hash").alias("chunk_hashes"), "text")


def pair_sources(pairs: DataFrame, chunks: DataFrame, most: int = PAIRS) -> DataFrame:
    """Sources of two chunks from the best pairs (chunk_a, chunk_b, score)."""
    best = pairs.orderBy(F.desc("score"), "chunk_a", "chunk_b").limit(most)
    side = lambda s: chunks.select(F.col("chunk_id").alias(f"chunk_{s}"), F.col("hash").alias(f"hash_{s}"), F.col("text").alias(f"text_{s}"))
    rows = best.join(side("a"), "chunk_a").join(side("b"), "chunk_b").withColumns({"chunk_ids": F.array("chunk_a", "chunk_b"), "chunk_hashes": F.array("hash_a", "hash_b")})
    return rows.select(I.source_key("chunk_ids", "chunk_hashes").alias("source_key"), "chunk_ids", "chunk_hashes", F.concat_ws("\n\n", "text_a", "text_b").alias("text"))


def verify_by_rule(rows: DataFrame) -> DataFrame:
    """``rows`` with ``supported, answerable, unambiguous`` told by words alone, for runs without a model.

    Reads fact, question, answer and text: the answer's parts stand in the text and most of the
    fact's words do; the question gives no part away and shares words with the text; two words
    of the question point at the fact.
    """
    parts = F.filter(F.transform(F.split("answer", ";"), F.trim), lambda p: p != "")
    fact, asked, have = X.content_tokens("fact"), X.content_tokens("question"), X.content_tokens("text")
    gold = F.flatten(F.transform(parts, X.content_tokens))
    leaked = F.exists(parts, lambda p: X.contains_normalized("question", p))
    return rows.withColumns({
        "supported": (F.size(parts) > 0) & F.forall(parts, lambda p: X.contains_normalized("text", p)) & (X.set_overlap(fact, have) >= 0.8),
        "answerable": ~leaked & F.arrays_overlap(asked, have),
        "unambiguous": F.size(F.array_intersect(asked, F.array_except(fact, gold))) >= 2,
    })
