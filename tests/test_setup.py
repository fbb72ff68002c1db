"""Background work, the project folder, the page to run it from, reports, and answers in text."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.plans import reports as H
from veritrail.plans import setup as S
from veritrail.plans.jobs import Busy, Jobs


def test_jobs(spark):
    jobs, go = Jobs(spark), threading.Event()

    def slow(job):
        go.wait(10)
        job.progress("after", 1, 2)
        return 5

    job = jobs.start("slow", slow)
    with pytest.raises(Busy):
        jobs.start("other", slow)
    go.set()
    assert jobs.wait(10)["state"] == "done" and job.result == 5
    assert jobs.start("bad", lambda job: 1 / 0) and jobs.wait(10)["error"] == "division by zero"
    udf = F.udf(lambda x: time.sleep(0.2) or x, "long")
    jobs.start("spark", lambda job: spark.range(0, 400, 1, 4).select(udf("id")).write.format("noop").mode("overwrite").save())
    time.sleep(1.5)
    assert jobs.cancel() and jobs.wait(30)["state"] == "cancelled" and not jobs.cancel()


def test_folder(spark, tmp_path):
    folder = str(tmp_path / "project")
    made = S.init(folder)
    assert "adapter.py" in made and S.init(folder) == []
    found = {c["check"]: c for c in S.doctor(folder)}
    assert all(c["ok"] for c in found.values()) and found["documents"]["note"] == "1 files" and found["adapter"]["note"] == "function"
    (tmp_path / "project" / "adapter.py").write_text("x = 1\n")
    assert not {c["check"]: c for c in S.doctor(folder)}["adapter"]["ok"]
    (tmp_path / "raises.py").write_text("raise RuntimeError('no')\n")
    for name, message in (("raises.py", "does not load"), ("project/adapter.py", "neither")):
        with pytest.raises(ValueError, match=message):
            S.load_adapter(str(tmp_path / name))


def test_page(spark, tmp_path):
    server, url = S.serve(str(tmp_path), Jobs(spark), lambda job: job.progress("counted", spark.range(3).count(), 3))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root, key = url.split("/?key=")

    def ask(path, method="GET", key=key):
        with urllib.request.urlopen(urllib.request.Request(root + path, method=method, headers={"X-Key": key})) as reply:
            return reply.read()

    assert b"<button" in ask("/") and json.loads(ask("/state")) is None
    assert json.loads(ask("/run", "POST"))["kind"] == "check"
    for _ in range(100):
        state = json.loads(ask("/state"))
        if state["state"] != "running":
            break
        time.sleep(0.1)
    assert state["state"] == "done" and state["done"] == 3 and json.loads(ask("/cancel", "POST")) == {"cancelled": False}
    with pytest.raises(urllib.error.HTTPError, match="403"):
        ask("/state", key="other")
    assert any(c["check"] == "python" for c in json.loads(ask("/doctor")))
    server.shutdown()


def test_reports(spark):
    q = spark.createDataFrame([("q1", "dev", "active", None, "Who?", "x", 0.2), ("q2", None, "rejected", "cross_split", "What <b>?", "y", 0.7)], "question_id string, split string, status string, reject_reason string, question string, gold_answer string, lexical_overlap double")
    page = H.generate_report(q)
    assert "cross_split" in page and "What &lt;b&gt;?" in page and page.count("<h2>") == 5
    trials = spark.createDataFrame([("t", 0, 10.0, "c0", "baseline"), ("t", 1, 30.0, "c1", "llm")], "tune_id string, trial_index int, score double, config string, source string")
    assert "llm" in H.tune_report(trials, spark.createDataFrame([(0, "pass"), (1, "retrieval_miss")], "trial_index int, failure_class string"))


@pytest.mark.parametrize(
    ("text", "answer"),
    [
        ("It opened on March 3, 2021 for $5 million.", "March 3, 2021"), ("It cost $5 million then.", "$5 million"), ("The run takes 45 minutes at most.", "45 minutes"), ("Doors open at 07:30 each day.", "07:30"),
        ("Since June 2019 it is so.", "June 2019"), ("On 2020-01-31 it closed.", "2020-01-31"), ("Take Line 2 for 12 stops today.", "12 stops"), ("A rise of 7.5% was seen.", "7.5%"), ("They moved 1,240 people.", "1,240 people"),
        ("He met Anna Berg of Mill House there.", "Anna Berg of Mill House"), ("The Old Mill stands.", None), ("It belongs to Anna's aunt.", None), ("nothing of the kind", None), ("", None),
    ],
)
def test_answer_span(spark, text, answer):
    assert spark.createDataFrame([(text,)], "t string").select(X.answer_span("t")).head()[0] == answer


def test_excerpts(spark):
    long = "word " * 300 + "needle <b> " + "tail " * 300
    rows = spark.createDataFrame([(long, "needle"), (long, "missing"), ("short  one", "ONE"), (long, ""), ("a.b a+b", "a.b")], "t string, a string")
    got = rows.select(X.excerpt("t", "a").alias("e"), X.highlight("t", "a").alias("h")).collect()
    at = " ".join(long.split()).index("needle")
    assert got[0]["e"].startswith("…") and got[0]["e"].endswith("…") and got[0]["e"][1:].index("needle") == 233 and at > 233
    assert "<b>needle</b> &lt;b&gt;" in got[0]["h"] and got[1]["e"].startswith("word") and got[3]["e"] == got[1]["e"]
    assert got[2]["h"] == "short <b>one</b>" and got[4]["h"] == "<b>a.b</b> a+b"
