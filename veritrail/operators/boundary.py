"""User pipelines and language models, the only Python that runs on rows here.

A call may be costly and differ each time: write what comes back before it is used twice.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_judgement

RESPONSE = "answer string, retrieved_chunk_ids array<string>, contexts array<string>, latency_ms double, error string"
#: Calls of one task that wait at the same time.
PARALLEL = 8
ATTEMPTS, BACKOFF, TIMEOUT = 3, 1.0, 60.0

CORRECT_PROMPT = 'Does the candidate answer state the expected answer? Reply with JSON only: {"is_correct": true or false, "score": 0 to 1, "rationale": ""}.'
GROUNDED_PROMPT = 'Do the contexts hold all that the answer says? Reply with JSON only: {"is_grounded": true or false, "score": 0 to 1, "rationale": ""}.'
ALONE_PROMPT = "Answer the question from what you know. No documents are given."


def retryable(why: Exception) -> bool:
    """Whether a call may succeed if repeated: too many requests, an error of the server, or of the connection."""
    code = getattr(why, "code", None)
    if isinstance(code, int):
        return code == 429 or code >= 500
    return isinstance(why, (OSError, TimeoutError))


class HttpClient:
    """A model behind an endpoint of chat completions: ``complete(system, user)`` returns the text of the first choice."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = TIMEOUT):
        self.url, self.model, self.key, self.timeout = url.rstrip("/") + "/chat/completions", model, key, timeout

    def complete(self, system: str, user: str) -> str:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


def call(client, system: str, user: str, attempts: int = ATTEMPTS, backoff: float = BACKOFF) -> tuple[str | None, str | None]:
    """Reply and error; a call that may succeed later is repeated after a doubled wait, others fail at once."""
    for n in range(attempts):
        try:
            return client.complete(system, user), None
        except Exception as why:
            if n + 1 == attempts or not retryable(why):
                return None, str(why)
            time.sleep(backoff * 2**n)
    return None, "no attempt"


def run_adapter(questions: DataFrame, make_adapter: Callable[[], object], key: str = "question_id", text: str = "question", parallel: int = 1) -> DataFrame:
    """``key`` and the response of a user pipeline to every question.

    ``make_adapter`` is called once a task and returns a callable or an object with ``query``.
    A response is a mapping with answer, retrieved_chunk_ids and contexts. An exception is a
    response too: an empty answer with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = make_adapter()
        query = getattr(adapter, "query", adapter)

        def ask(pair: tuple) -> tuple:
            began = time.perf_counter()
            try:
                r, error = dict(query(pair[1])), None
            except Exception as why:
                r, error = {}, str(why)
            latency = r.get("latency_ms") or (time.perf_counter() - began) * 1000
            return pair[0], r.get("answer", ""), list(r.get("retrieved_chunk_ids", [])), list(r.get("contexts", [])), round(float(latency), 2), error

        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                rows = list(pool.map(ask, zip(batch[key], batch[text])))
                yield pd.DataFrame(rows, columns=[key, "answer", "retrieved_chunk_ids", "contexts", "latency_ms", "error"])

    kind = questions.schema[key].dataType.simpleString()
    return questions.select(key, text).mapInPandas(run, f"{key} {kind}, {RESPONSE}")


def complete(prompts: DataFrame, make_client: Callable[[], object], key: str = "question_id", attempts: int = ATTEMPTS, backoff: float = BACKOFF, parallel: int = 1) -> DataFrame:
    """``key, reply, error`` for ``key, system, user`` prompts; a client has ``complete(system, user)``.

    See :func:`call` for failures. ``parallel`` calls of a task wait at the same time; the
    client must allow that.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                replies = list(pool.map(lambda p: call(client, p[0], p[1], attempts, backoff), zip(batch["system"], batch["user"])))
                yield pd.DataFrame([(k, *r) for k, r in zip(batch[key], replies)], columns=[key, "reply", "error"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "system", "user").mapInPandas(run, f"{key} {kind}, reply string, error string")


class _Strict:
    """A client that asks once more if the reply has no flag."""

    def __init__(self, client, flag: str):
        self.client, self.flag = client, flag

    def complete(self, system: str, user: str) -> str:
        for _ in range(2):
            reply = self.client.complete(system, user)
            try:
                if isinstance(json.loads(reply).get(self.flag), bool):
                    break
            except (ValueError, AttributeError):
                continue
        return reply


def judge(prompts: DataFrame, make_client: Callable[[], object], flag: str = "is_correct", key: str = "question_id", backoff: float = BACKOFF) -> DataFrame:
    """``key``, the flag, score, rationale and ``judge_failed``: one retry of a reply that can't be read, then false."""
    replies = complete(prompts, lambda: _Strict(make_client(), flag), key, backoff=backoff)
    parsed = replies.withColumn("j", parse_judgement("reply", flag))
    return parsed.select(key, F.coalesce(f"j.{flag}", F.lit(False)).alias(flag), "j.score", "j.rationale", F.col("j").isNull().alias("judge_failed"))


def judge_correctness(answers: DataFrame, make_client: Callable[[], object], key: str = "question_id") -> DataFrame:
    """:func:`judge` of ``key, question, expected, answer`` rows."""
    user = F.concat(F.lit("Question: "), "question", F.lit("\nExpected answer: "), "expected", F.lit("\nCandidate answer: "), "answer")
    return judge(answers.select(key, F.lit(CORRECT_PROMPT).alias("system"), user.alias("user")), make_client, "is_correct", key)


def judge_groundedness(answers: DataFrame, make_client: Callable[[], object], key: str = "question_id") -> DataFrame:
    """:func:`judge` of ``key, answer, contexts`` rows."""
    user = F.concat(F.lit("Contexts:\n"), F.array_join("contexts", "\n---\n"), F.lit("\n\nAnswer:\n"), "answer")
    return judge(answers.select(key, F.lit(GROUNDED_PROMPT).alias("system"), user.alias("user")), make_client, "is_grounded", key)


class RuleJudge:
    """A judge without a model, for the prompts above: words of the expected answer, or of the answer, that are there."""

    def complete(self, system: str, user: str) -> str:
        if system == CORRECT_PROMPT:
            head, _, answer = user.partition("\nCandidate answer: ")
            wanted, have = head.partition("\nExpected answer: ")[2], set(answer.lower().split())
            ok = all(w in have for w in wanted.lower().split())
            return json.dumps({"is_correct": ok, "score": float(ok), "rationale": None})
        contexts, _, answer = user.partition("\n\nAnswer:\n")
        words, have = set(answer.lower().split()), set(contexts.removeprefix("Contexts:\n").lower().split())
        share = len(words & have) / len(words) if words else 0.0
        return json.dumps({"is_grounded": share >= 0.8, "score": math.floor(share * 1000 + 0.5) / 1000, "rationale": None})


def ablate(cases: DataFrame, make_client: Callable[[], object], key: str = "question_id") -> DataFrame:
    """``cases`` with ``confirmed``: lucky passes asked again without context, right again; null for others."""
    from .scoring import judge_correct

    lucky = cases.where("verdict = 'lucky_pass'").select(key, F.lit(ALONE_PROMPT).alias("system"), F.col("question").alias("user"))
    again = complete(lucky, make_client, key).select(key, F.coalesce("reply", F.lit("")).alias("__again"))
    joined = cases.join(again, key, "left")
    return joined.withColumn("confirmed", F.when(F.col("__again").isNotNull(), judge_correct("expected", "__again"))).drop("__again")
