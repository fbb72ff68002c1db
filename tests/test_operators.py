import pytest
from pyspark.sql import functions as F

from veritrail.functions import ids as I
from veritrail.operators import chunking as C
from veritrail.operators import history as H
from veritrail.operators import planning as P
from veritrail.operators import retrieval as V
from veritrail.operators import scoring as S
from veritrail.operators import tuning as T
from veritrail.operators import versioning as N


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.mark.parametrize(("length", "starts"), [(0, 0), (1, 1), (700, 1), (701, 2), (800, 2), (801, 2), (1500, 3)])
def test_chunk_fixed(spark, length, starts):
    text = ("ab😀é" * 500)[:length]
    got = C.chunk_fixed(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("position").collect()
    assert [r["text"] for r in got] == [text[s : s + 800] for s in range(0, length, 700)] and len(got) == starts


def test_chunk_errors(spark):
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            C.chunk_fixed(spark.createDataFrame([("x",)], "text string"), "text", size, overlap)


def test_chunk_pack(spark):
    text = "one two.\n\nthree\n\n" + "Long sentence here. " * 3 + "\n\n" + "x" * 50
    got = [r["text"] for r in C.chunk_pack(spark.createDataFrame([(text,)], "text string"), "text", 30).orderBy("position").collect()]
    assert got == ["one two.\nthree", "Long sentence here.", "Long sentence here.", "Long sentence here.", "x" * 30, "x" * 20]


@pytest.mark.parametrize(("gold", "got", "k", "expected"), [(["a"], ["x", "a", "y"], 5, (1.0, 0.5, True)), (["a"], ["x", "y", "a"], 2, (0.0, 0.0, False)), (["a", "b"], ["b", "x"], 5, (0.5, 1.0, False)), (["a", "b"], ["b", "a"], 5, (1.0, 1.0, True)), ([], ["a"], 5, (0.0, 0.0, False))])
def test_recall(spark, gold, got, k, expected):
    df = spark.createDataFrame([(gold, got)], "gold array<string>, got array<string>")
    assert tuple(df.select(*(c.alias(n) for n, c in V.recall_at_k(F.col("gold"), F.col("got"), k).items())).head()) == expected


def test_diff_and_version(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "chunk_id string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "chunk_id string, hash string")
    assert rows(N.diff_corpus(old, new)) == [("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")]
    version = lambda hs: I.index_version(spark.createDataFrame([(h,) for h in hs], "h string"), "h").head()[0]
    assert version(["x", "y"]) == version(["y", "x", "x"]) != version(["x"])


def test_staleness_reverts(spark):
    q = spark.createDataFrame([("q1", ["a"], ["1"], "active"), ("q2", ["a", "b"], ["1", "2"], "stale"), ("q3", ["z"], ["1"], "rejected"), ("q4", ["z"], ["1"], "active")], "question_id string, chunk_ids array<string>, chunk_hashes array<string>, status string")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "chunk_id string, hash string")
    assert rows(N.staleness(q, now).select("question_id", "status")) == [("q1", "active"), ("q2", "active"), ("q3", "rejected"), ("q4", "stale")]


def test_history_delta(spark):
    runs = spark.createDataFrame([("r1", "check", 1, "a"), ("r2", "check", 2, "b"), ("t1", "tune", 3, "b")], "run_id string, kind string, created_at int, fingerprint string")
    out = [("r1", "q1", "true_pass"), ("r1", "q2", "retrieval_failure"), ("r1", "q3", "true_pass"), ("r2", "q1", "true_pass"), ("r2", "q2", "true_pass"), ("r2", "q4", "retrieval_failure")]
    got = {r["run_id"]: r for r in H.history_delta(runs, spark.createDataFrame(out, "run_id string, question_id string, verdict string")).collect()}
    r2 = got["r2"]
    assert (r2["shared_questions"], r2["delta_true_pass"], r2["delta_retrieval_hit"], r2["true_pass_pct"], r2["small_sample"], r2["corpus_changed"]) == (2, 50.0, 50.0, 66.7, True, True)
    assert got["t1"]["prev_run_id"] is None and got["t1"]["delta_true_pass"] is None and got["t1"]["n_questions"] == 0


@pytest.mark.parametrize(("chunks", "questions", "expected"), [(10, 5, [(0, 1), (2, 1), (4, 1), (6, 1), (8, 1)]), (3, 8, [(0, 3), (1, 3), (2, 2)]), (3, 3, [(0, 1), (1, 1), (2, 1)]), (3, 0, []), (7, 3, [(0, 1), (2, 1), (4, 1)])])
def test_spread(spark, chunks, questions, expected):
    assert rows(P.spread(spark.range(chunks), questions, ["id"])) == expected


def test_costs():
    assert P.check_cost(3, 8) == (19, 35)
    assert P.improve_cost(100, 8, 400)["total_calls"] <= 400


def test_histogram(spark):
    values = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.45, 0.5, 0.51, 1.0)], "v double")
    got = {b: (n, kept) for b, n, kept in rows(S.overlap_histogram(values, "v"))}
    assert got[0] == (2, True) and got[4] == (2, True) and got[5] == (1, False) and got[9] == (1, False) and len(got) == 10


def cases(spark, data):
    return spark.createDataFrame(data, "verdict string, hit boolean, is_correct boolean, groundedness double, judge_failed boolean, confirmed boolean")


def test_summaries(spark):
    empty = S.run_summary(cases(spark, [])).head()
    assert (empty["total_cases"], empty["retrieval_hit_rate"], empty["mean_groundedness"], empty["ablation_confirmed_count"]) == (0, 0.0, None, None)
    some = S.run_summary(cases(spark, [("true_pass", True, True, 1.0, True, None), ("lucky_pass", False, True, None, False, None)])).head()
    assert (some["n_lucky_pass"], some["ablation_confirmed_count"], some["judge_failure_count"], some["mean_groundedness"]) == (1, 0, 1, 1.0)


def test_score_and_class(spark):
    data = [("pass", "true_pass", True, 1.0, 1.0, False, None, None)] * 3 + [("retrieval_miss", "lucky_pass", True, 0.0, 0.0, False, None, None)]
    got = S.eval_summary(spark.createDataFrame(data, "failure_class string, verdict string, is_correct boolean, recall double, reciprocal_rank double, judge_failed boolean, adapter_error string, confirmed boolean")).head()
    assert (got["score"], got["answer_accuracy"], got["lucky_pass_confirmed"]) == (75.0, 1.0, None)
    assert spark.range(1).select(S.failure_class(F.lit(False), F.lit(True))).head()[0] == "retrieval_miss"


def test_plain_summary(spark):
    base = {"total_cases": 10, "n_true_pass": 8, "n_lucky_pass": 1, "n_generation_failure": 0, "n_retrieval_failure": 1, "hits": 8, "match_by": "id", "any_context": True}
    run = lambda **c: S.plain_summary(spark.createDataFrame([base | c])).head()
    assert run()["status"] == "healthy"
    assert (run(n_true_pass=7)["status"], run(n_true_pass=7)["problem"]) == ("needs_work", "retrieval_failure")
    assert run(hits=0, n_true_pass=0)["advice"] == "match_by_text"
    assert run(match_by="text", any_context=False)["advice"] == "return_contexts"
    assert run(total_cases=0)["status"] == "empty"


def test_regression_mode(spark):
    q = spark.range(23).select(F.col("id").cast("string").alias("question_id"))
    mode, chosen = P.select_questions(q, q.where("question_id < 20"), "v1", "v2", sample=5)
    assert mode == "regression" and chosen.count() == 8 and chosen.where("is_new").count() == 3
    assert P.select_questions(q, q.limit(0), None, "v2")[0] == "full" and P.select_questions(q, q, "v2", "v2")[0] == "cached"


def test_search_space():
    space = T.SearchSpace({"k": {"min": 1, "max": 3, "step": 1}, "mode": ["a", "b"]})
    assert space.size == 6 and space.baseline == {"k": 1, "mode": "a"} and P.knob_values({"min": 0.0, "max": 0.3, "step": 0.1}) == [0.0, 0.1, 0.2, 0.3]
    for wrong in ({"k": 9}, {"other": 1}):
        with pytest.raises(ValueError):
            space.check(wrong)


def test_tune(spark):
    space = T.SearchSpace({"k": [1, 2, 3, 4], "mode": ["a", "b"]})

    def evaluate(config):
        good = config["k"] + (config["mode"] == "b")
        return spark.createDataFrame([("pass",)] * good + [("retrieval_miss",)] * (6 - good), "failure_class string")

    got = T.tune(space, evaluate, lambda c: 10.0 * c["k"], trials=20)
    assert got["best"]["config"] == {"k": 4, "mode": "b"} and got["stopped"] == "exhausted" and len(got["trials"]) == 8 and got["best_exam"] == 40.0 and got["overfit"]
    assert T.tune(space, evaluate, lambda c: 0.0, trials=20, calls_per_trial=10, budget=45)["stopped"] == "budget"


def test_budget(spark):
    work = spark.createDataFrame([(i, c) for i, c in enumerate([3, 3, 9, 1])], "i int, cost int")
    assert [r["i"] for r in P.within_budget(work, 6, ["i"]).collect()] == [0, 1]
