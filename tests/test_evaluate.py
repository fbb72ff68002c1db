"""Scoring a pipeline, its cache, settings by a model, calls over HTTP, and arguments."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from veritrail.operators import boundary as B
from veritrail.operators import planning as P
from veritrail.operators import tuning as T
from veritrail.operators.retrieval import text_recall_at_k
from veritrail.plans.evaluate import evaluate, run_test_set
from veritrail.sources.tables import Store

LONG = "the old mill by the river has twelve wooden wheels and a roof of slate that was mended in spring"


def adapter():
    def ask(question):
        if "broken" in question:
            raise ValueError("no index")
        return {"answer": "twelve wheels" if "wheels" in question else "no idea", "retrieved_chunk_ids": ["c1", "c2"], "contexts": [LONG, "something else"]}

    return ask


class Alone:
    def complete(self, system, user):
        return "twelve wheels"


QUESTIONS = [
    ("q1", "how many wheels?", "twelve", ["c1"]), ("q2", "how many wheels there?", "twelve", ["c9"]),
    ("q3", "which roof?", "slate", ["c1"]), ("q4", "which river?", "avon", ["c9"]), ("q5", "broken?", "x", ["c1"]),
]


@pytest.fixture()
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id string, question string, expected string, chunk_ids array<string>")


def test_run(spark, questions):
    cases, summary = run_test_set(questions, adapter, B.RuleJudge, make_alone=Alone)
    got = {r["question_id"]: r for r in cases.collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {"q1": "true_pass", "q2": "lucky_pass", "q3": "generation_failure", "q4": "retrieval_failure", "q5": "retrieval_failure"}
    assert got["q5"]["adapter_error"] == "no index" and not got["q5"]["is_correct"] and got["q2"]["confirmed"] is True and got["q1"]["confirmed"] is None
    row = summary.head()
    assert row["total_cases"] == 5 and row["n_true_pass"] == 1 and row["ablation_confirmed_count"] == 1 and got["q1"]["groundedness"] == 1.0


def test_text_mode(spark, questions):
    chunks = spark.createDataFrame([("c1", LONG), ("c9", "a passage about nothing of the kind at all, and that is that")], "chunk_id string, text string")
    cases, _ = run_test_set(questions, adapter, B.RuleJudge, match_by="text", chunks=chunks, grounded=False)
    assert {r["question_id"]: r["hit"] for r in cases.collect()} == {"q1": True, "q2": False, "q3": True, "q4": False, "q5": False}
    two = spark.createDataFrame([("a", ["c1", "c9"], ["x y z", LONG]), ("b", [], [LONG])], "question_id string, chunk_ids array<string>, contexts array<string>")
    got = {r["question_id"]: (r["recall"], r["reciprocal_rank"], r["hit"]) for r in text_recall_at_k(two, chunks, 5).collect()}
    assert got == {"a": (0.5, 0.5, False), "b": (0.0, 0.0, False)}
    with pytest.raises(Exception, match="no chunk"):
        text_recall_at_k(two, chunks.where("chunk_id = 'c1'"), 5).collect()


def test_cache(spark, questions, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    mode, summary = evaluate(store, questions.where("question_id < 'q4'"), adapter, B.RuleJudge, "c", "v1")
    assert mode == "full" and summary.head()["n_questions"] == 3

    def never():
        raise AssertionError("asked again")

    mode, summary = evaluate(store, questions.where("question_id < 'q4'"), never, B.RuleJudge, "c", "v1", last_index="v1")
    assert mode == "cached" and summary.head()["n_pass"] == 1
    mode, summary = evaluate(store, questions, adapter, B.RuleJudge, "c", "v2", last_index="v1", sample=1)
    assert mode == "regression" and summary.head()["n_questions"] == 3
    assert store.read("results").count() == 6


def test_proposals():
    assert T.parse_proposal('```json\n{"config": {"k": 2}, "rationale": "r"}\n```') == ({"k": 2}, "r") and T.parse_proposal('{"config": {}}') == ({}, None)
    assert T.parse_proposal("sure") is None and T.parse_proposal('{"config": [1]}') is None and T.parse_proposal('{"config": {"k": 1}, "rationale": 3}') == ({"k": 1}, None)
    space = T.SearchSpace({"k": [1, 2, 3], "mode": ["a", "b"]})

    class Model:
        def __init__(self, *replies):
            self.replies, self.seen = list(replies), []

        def complete(self, system, user):
            self.seen.append(user)
            return self.replies.pop(0)

    tried = {T.key_of(space.baseline)}
    good = Model('{"config": {"k": 3}, "rationale": "more"}')
    assert T.llm_proposal(space, good, 0, [], tried) == {"config": {"k": 3, "mode": "a"}, "source": "llm", "rationale": "more"}
    second = Model('{"config": {"k": 9}}', '{"config": {"k": 2}}')
    assert T.llm_proposal(space, second, 0, [], tried)["config"]["k"] == 2 and "refused" in second.seen[1]
    fallback = T.llm_proposal(space, Model("x", '{"config": {"k": 1}}'), 0, [], tried)
    assert fallback["source"] == "llm_fallback" and T.key_of(fallback["config"]) not in tried and "tried before" in fallback["rationale"]
    assert T.llm_proposal(space, Model(), 0, [], {T.key_of({"k": k, "mode": m}) for k in (1, 2, 3) for m in "ab"}) is None


def test_repeated_values_end():
    space = T.SearchSpace({"k": [1, 1]})
    assert space.size == 1 and next(T.random_proposals(space, 0, {T.key_of(space.baseline)}), None) is None
    wide = T.SearchSpace({f"k{i}": list(range(9)) for i in range(9)})
    tried = set()
    for config, _ in zip(T.random_proposals(wide, 0, tried), range(20)):
        tried.add(T.key_of(config))
    assert len(tried) == 20


def test_small_budget_is_refused(spark):
    space = T.SearchSpace({"k": [1, 2]})
    frame = spark.createDataFrame([("pass",)], "failure_class string")
    with pytest.raises(ValueError, match="too small"):
        T.tune(space, lambda c: frame, lambda c: 0.0, calls_per_trial=10, budget=29)
    assert T.tune(space, lambda c: frame, lambda c: 0.0, calls_per_trial=10, budget=30)["stopped"] == "budget"


def test_arguments():
    P.check_arguments("text", 1, 500, 1)
    for wrong in ({"match_by": "name"}, {"k": 0}, {"questions": 501}, {"questions": 0}, {"budget": 0}):
        with pytest.raises(ValueError):
            P.check_arguments(**wrong)


def test_http():
    calls = []

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            user = body["messages"][1]["content"]
            calls.append(user)
            code = {"busy": 429 if calls.count("busy") < 3 else 200, "down": 503, "wrong": 400}.get(user, 200)
            data = json.dumps({"choices": [{"message": {"content": f"re: {user}"}}]}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = B.HttpClient(f"http://127.0.0.1:{server.server_port}/v1", "m", "secret")
    assert B.call(client, "s", "hello", backoff=0.0) == ("re: hello", None)
    assert B.call(client, "s", "busy", backoff=0.0) == ("re: busy", None) and calls.count("busy") == 3
    assert B.call(client, "s", "down", backoff=0.0)[0] is None and calls.count("down") == 3
    assert B.call(client, "s", "wrong", backoff=0.0)[0] is None and calls.count("wrong") == 1
    server.shutdown()
    assert B.call(client, "s", "hello", attempts=2, backoff=0.0)[1]


def test_fresh_pool(spark):
    pool = spark.createDataFrame([("q", "c", "h")], "question_key string, chunk_id string, chunk_hash string")
    now = spark.createDataFrame([("c", "h")], "chunk_id string, hash string")
    action = lambda **how: P.plan_pool(pool, now, now, **how).head()["action"]
    assert action() == "reuse" and action(fresh=True) == "fresh" and action(target=5, last_target=4) == "fresh" and action(target=5, last_target=5) == "reuse"
