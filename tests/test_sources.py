import json

import pytest
from pyspark.sql import functions as F

from veritrail.operators import boundary as B
from veritrail.sources import corpus as L
from veritrail.sources import settings as E
from veritrail.sources import tables as K
from veritrail.streaming.feeds import event_rates, sync_corpus


def test_text_dir(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("alpha")
    (tmp_path / "sub" / "b.TXT").write_text("béta")
    (tmp_path / "c.csv").write_text("no")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    got = L.scan_text_dir(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["path"], r["text"]) for r in got] == [("a.md", "alpha"), ("sub/b.TXT", "béta")]
    assert [r["chunk_id"] for r in L.load_corpus(spark, str(tmp_path), lines=False).orderBy("chunk_id").collect()] == ["a.md#0", "sub/b.TXT#0"]


def lines(tmp_path, *rows):
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = lines(tmp_path, {"chunk_id": "x", "text": "one", "tag": "t", "n": 3, "timestamp": "2024-01-02"}, "", {"chunk_id": "y", "text": "two", "doc_id": "d", "position": 7})
    got = L.load_corpus(spark, path, lines=True).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["doc_id"], r["position"], r["metadata"]) for r in got] == [("x", "x", 0, {"tag": "t"}), ("y", "d", 7, {})]
    assert str(got[0]["timestamp"]).startswith("2024-01-02")


@pytest.mark.parametrize(("row", "message"), [("{", "invalid"), ("[1]", "object"), ({"text": "x"}, "chunk_id"), ({"chunk_id": "a", "text": " "}, "blank"), ({"chunk_id": "a", "text": "x", "timestamp": "soon"}, "ISO")])
def test_jsonl_errors(spark, tmp_path, row, message):
    with pytest.raises(ValueError, match=f"line 2.*{message}"):
        L.load_corpus(spark, lines(tmp_path, {"chunk_id": "ok", "text": "x"}, row), lines=True)


def test_duplicate_ids(spark, tmp_path):
    with pytest.raises(ValueError, match="occurs 2"):
        L.load_corpus(spark, lines(tmp_path, {"chunk_id": "a", "text": "x"}, {"chunk_id": "a", "text": "y"}), lines=True)


def test_settings():
    assert E.parse_dotenv("# c\nexport A='1'\nB=2 # note\nbad\n", {"B": "9"}) == {"A": "1", "B": "9"}
    assert E.parse_yaml("knobs:\n  k: [1, 2]\n  w: {min: 0, max: 1, step: 0.5}\nbaseline:\n  k: 2 # c\n") == {"knobs": {"k": [1, 2], "w": {"min": 0, "max": 1, "step": 0.5}}, "baseline": {"k": 2}}
    assert E.parse_yaml(E.write_yaml({"k": 3, "mode": "a"}, "best")) == {"k": 3, "mode": "a"}


def test_store(spark, tmp_path):
    store = K.Store(spark, str(tmp_path / "s"))
    make = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert store.insert_new("t", make(("a", 1), ("b", 2)), ["k"]) == 2
    assert store.insert_new("t", make(("a", 9), ("c", 3)), ["k"]) == 1
    store.save("t", make(("b", 7)), ["k"])
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1), ("b", 7), ("c", 3)]


def test_lock(spark):
    q = spark.createDataFrame([("q", "test", "active", 1)], "question_id string, split string, status string, created_at int")
    with pytest.raises(K.LockedSplit):
        K.guarded(q, ("dev", "test"), ("active",))
    assert K.guarded(q, ("test",), ("active",), unlocked=True).count() == 1 and K.guarded(q, ("test",), ("rejected",)).count() == 0 and K.dev_view(q).count() == 0


class Flaky:
    def __init__(self):
        self.calls = 0

    def complete(self, system, user):
        self.calls += 1
        if user == "down" or (user == "late" and self.calls % 3):
            raise OSError("no")
        return '{"is_correct": true}' if user != "odd" else "?"


def test_boundary(spark):
    prompts = spark.createDataFrame([("1", "", "ok"), ("2", "", "late"), ("3", "", "down"), ("4", "", "odd")], "question_id string, system string, user string").coalesce(1)
    got = {r["question_id"]: r for r in B.judge(prompts.where("user <> 'late'"), Flaky).collect()}
    assert got["1"]["is_correct"] and not got["3"]["is_correct"] and got["3"]["judge_failed"] and got["4"]["judge_failed"]
    replies = {r["question_id"]: r for r in B.complete(prompts, Flaky, backoff=0.0).collect()}
    assert replies["2"]["reply"] and replies["3"]["error"] == "no"


def test_stream(spark, tmp_path):
    store = K.Store(spark, str(tmp_path / "s"))
    for i, rows in enumerate([[("a", "one", 1), ("b", "two", 1)], [("a", "new", 2), ("b", "old", 0), ("c", None, 3)]]):
        spark.createDataFrame(rows, "chunk_id string, text string, changed_at long").coalesce(1).write.json(str(tmp_path / "in" / str(i)))
        feed = spark.readStream.schema("chunk_id string, text string, changed_at long").json(str(tmp_path / "in" / "*"))
        sync_corpus(feed, store, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r["chunk_id"], r["text"]) for r in store.read("chunks").collect()) == [("a", "new"), ("b", "two"), ("c", None)]


def test_event_rates(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["total"]) for r in event_rates(events).collect()) == [(1, 4.0), (2, 3.0)]
