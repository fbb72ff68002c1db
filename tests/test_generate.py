import json

from pyspark.sql import functions as F

from veritrail.boundary_queries import sink_html_report
from veritrail.operators.planning import candidate_pairs
from veritrail.plans import generate as G
from veritrail.plans import reports
from veritrail.plans.reports import best_config, html_report, json_for_html
from veritrail.queries import Tables


class Writer:
    """Plays the generator by the first line of what it is shown."""

    def complete(self, system, user):
        first = user.split("\n")[0]
        if "facts" in system:
            if "broken" in user:
                return "sorry"
            return json.dumps({"facts": [{"fact": "The old mill has 12 wheels", "answer": "12"}, {"fact": "12", "answer": "12"}]})
        if "questions" in system:
            return json.dumps({"questions": [{"question": "How many?", "answer": "12"}, {"question": "", "answer": "x"}]})
        if "other words" in system:
            return '{"question": "How many rotors turn at that old place?"}' if "near" not in user else '{"question": "What near does the mill have today?"}'
        return json.dumps({"question": f"How many wheels has the old mill? {first[:0]}"})


class Judge:
    def complete(self, system, user):
        return '{"supported": true, "answerable": true, "unambiguous": ' + ("false" if "vague" in user else "true") + "}"


def chunks(spark, *texts):
    return spark.createDataFrame([(f"d#{i}", "d", i, t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, position int, text string").withColumn("hash", F.sha2("text", 256))


def test_questions(spark):
    rows = chunks(spark, "The old mill has 12 wheels.", "broken", "The old mill has 12 wheels. vague", "The old mill has 12 wheels near it.")
    got = {r["chunk_ids"][0]: r for r in G.generate_questions(G.single_sources(rows), Writer, Judge).collect()}
    assert set(got) == {"d#0", "d#2", "d#3"}
    assert (got["d#0"]["status"], got["d#0"]["question"], got["d#0"]["gold_answer"]) == ("active", "How many rotors turn at that old place?", "12")
    assert got["d#2"]["reject_reason"] == "ambiguous" and got["d#3"]["reject_reason"] in ("too_lexical", "relative_time")


def test_pairs(spark):
    rows = chunks(spark, *[f"The old mill has 12 wheels, part {i}." for i in range(12)])
    pairs = candidate_pairs(rows.withColumn("tokens", F.split("text", " ")), similar=False)
    got = G.generate_questions(G.pair_sources(pairs, rows), Writer, Judge)
    assert 0 < got.count() <= G.PAIRS and got.where("size(chunk_ids) = 2 AND split IS NOT NULL").count() == got.count()


def test_tests(spark):
    got = G.generate_tests(chunks(spark, "a", "b"), Writer, 2).collect()
    assert len(got) == 2 and len({r["test_id"] for r in got}) == 2 and got[0]["answer"] == "12"


def test_rule_verifier(spark):
    rows = spark.createDataFrame([("The old mill has 12 wheels", "How many wheels has the mill?", "12", "The old mill has 12 wheels."), ("The old mill has 12 wheels", "Is it 12?", "12", "The old mill has 12 wheels."), ("The sky is green", "Is the sky green?", "7", "The old mill.")], "fact string, question string, answer string, text string")
    got = [(r["supported"], r["answerable"], r["unambiguous"]) for r in G.verify_by_rule(rows).collect()]
    assert got[0] == (True, True, True) and got[1] == (True, False, False) and got[2][0] is False


def test_reports(spark):
    page = html_report("A & B", {"rows": spark.createDataFrame([("<b>", 1), ("x", None)], "t string, n int")})
    assert "A &amp; B" in page and "&lt;b&gt;" in page and "<b>" not in page
    assert json_for_html({"a": "</script>&"}) == '{"a":"\\u003c/script\\u003e\\u0026"}'
    assert best_config({"k": 3}, 75.0, "t1").splitlines()[-1] == "k: 3"


def test_report_is_whole(spark):
    n = 2500
    rows = spark.range(0, n, 1, 3).selectExpr("id", "concat('<', id, '>\r\n') AS t").orderBy("id")
    page = html_report("Rows", {"rows": rows, "none": rows.where("id < 0")})
    table, rest = page.split("</table>", 1)
    assert table.count("<tr>") == n + 1 and [int(x.split("<")[0]) for x in table.split("<tr><td>")[1:]] == list(range(n))
    shown = [json.loads(x.split("</script>")[0]) for x in page.split("<script type='application/json'>")[1:]]
    assert shown == [[{"id": i, "t": f"<{i}>\r\n"} for i in range(n)], []]


def test_report_of_all_runs(spark, tmp_path, monkeypatch):
    ids, n = [0, *(i for i in range(60) if i % 5)], 12
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(s, k, 10.0 * k, "F") for s in "ab" for k in range(n)], "o_orderpriority string, o_orderkey long, o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    pieces, told = [], reports.html_pieces
    monkeypatch.setattr(reports, "html_pieces", lambda *a: (pieces.append(p) or p for p in told(*a)))
    assert [tuple(r) for r in sink_html_report(Tables(spark, str(tmp_path))).collect()] == [(4, 4, 1)]
    parts = {p.split("</h2>")[0]: p for p in "".join(pieces).split("<h2>")[1:]}
    shown = {name: json.loads(p.split("<script type='application/json'>")[1].split("</script>")[0]) for name, p in parts.items()}
    assert all(p.split("</table>")[0].count("<tr>") == len(shown[name]) + 1 for name, p in parts.items())
    assert [(r["run_id"], r["question_id"]) for r in shown["Questions"]] == sorted((i % 5, i // 5) for i in ids)
    assert [(r["run_id"], r["total_cases"]) for r in shown["Summary"]] == [(r["run_id"], r["n"]) for r in shown["Reading"]] == [(0, 1), (1, n), (2, n), (3, n), (4, n)]
    assert [(r["tune_id"], r["trial_index"], r["x"]) for r in shown["Improvement loop"]] == [(s, k, k + 1) for s in "ab" for k in range(n)]
