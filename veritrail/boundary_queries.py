"""Queries for user pipelines, model calls, settings, searches and reports, each with its DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .functions import ids as I
from .functions import text as X
from .operators import boundary as B
from .operators import planning as P
from .operators import retrieval as V
from .operators import tuning as U
from .operators.cases import LABELS
from .plans import evaluate as W
from .plans import generate as G
from .plans import reports as H
from .plans import sql as Q
from .plans.jobs import Jobs
from .plans.scratch import new_path
from .queries import CASES, query
from .sources import corpus as L
from .sources import settings as Z
from .sources import tables as K

# --- sources and settings ------------------------------------------------------------------


@query("SELECT count(*) AS n, sum(octet_length(encode(replace(replace(text, chr(10), ' '), chr(13), ' '))))::BIGINT + count(*) AS bytes FROM documents WHERE text IS NOT NULL")
def scan_text_dir(t):
    """All documents as the lines of text files, and what the files hold."""
    path = new_path(t.spark, "text-dir")
    t.documents.where("text IS NOT NULL").select(F.regexp_replace("text", r"[\n\r]", " ").alias("value")).repartition(8, F.rand(1)).write.text(path)
    files = L.scan_text_dir(t.spark, path)
    return files.agg(F.sum(F.size(F.split("text", "\n")) - 1).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


_YAML = "# space\nknobs:\n  k: {min: 1, max: 3, step: 1}\n  mode: [plain, hybrid]\n  w:\n    - 0.5\n    - 1\nbaseline:\n  mode: hybrid  # the last\n"


@query("SELECT * FROM (VALUES ('k', '[1, 2, 3]', '1'), ('mode', '[\"plain\", \"hybrid\"]', '\"hybrid\"'), ('w', '[0.5, 1]', '0.5')) v(knob, knob_values, baseline)")
def scan_yaml(t):
    found = Z.parse_yaml(_YAML)
    space = U.SearchSpace(found["knobs"], found["baseline"])
    return t.spark.createDataFrame([(n, json.dumps(v), json.dumps(space.baseline[n])) for n, v in space.values.items()], "knob string, knob_values string, baseline string")


@query("SELECT * FROM (VALUES ('A', 'plain'), ('B', 'two words'), ('C', 'kept'), ('D', 'of the shell')) v(name, setting)")
def scan_dotenv(t):
    found = Z.parse_dotenv("# comment\nA=plain\nexport B='two words'\nC=kept # note\nD=of the file\nnonsense\n", {"D": "of the shell", "E": "other"})
    return t.spark.createDataFrame(sorted(found.items()), "name string, setting string")


@query("SELECT '# best settings of t1' || chr(10) || '# practice score 75.0' || chr(10) || 'k: 3' || chr(10) || 'mode: \"a\"' || chr(10) AS yaml")
def sink_best_config(t):
    return t.spark.createDataFrame([(H.best_config({"k": 3, "mode": "a"}, 75.0, "t1"),)], "yaml string")


@query("SELECT source, replace(replace('{\"n\":' || count(*) || ',\"tag\":\"' || '</script>&' || '\"}', '<', '\\u003c'), '>', '\\u003e').replace('&', '\\u0026') AS json FROM documents GROUP BY source")
def json_for_html(t):
    counted = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()
    return t.spark.createDataFrame([(r["source"], H.json_for_html({"n": r["n"], "tag": "</script>&"})) for r in counted], "source string, json string")


@query(f"WITH {CASES} SELECT 4 AS sections, (SELECT count(DISTINCT verdict) FROM cases) AS verdicts, (SELECT count(*) FROM cases WHERE run_id = 0) AS explained")
def sink_html_report(t):
    """The page of all runs, told by what stands in it; ``explained`` are its cases of run 0."""
    rows = t.cases.withColumns(
        {
            "question": F.lit("q"), "expected": F.lit("the"), "answer": F.lit("a"), "rank": F.when(F.col("hit"), 1), "contexts": F.array(F.lit("the <passage>")), "gold_text": F.lit("the gold"),
            "rationale": F.lit(None).cast("string"), "error": F.col("adapter_error"),
        }
    )
    section, heads, labels, explained = "", 0, set(), 0
    for piece in H.html_pieces("Check", H.run_sections(rows, t.runs, t.trials, ["run_id"])):
        if piece.startswith("<h2>"):
            section, heads = piece[4:].split("</h2>")[0], heads + 1
        elif section == "Questions" and piece.startswith("<tr>"):
            labels |= {label for label in LABELS.values() if f"<td>{label}</td>" in piece}
            explained += piece.startswith("<tr><td>0</td>")
    return t.spark.createDataFrame([(heads - 1, len(labels), explained)], "sections bigint, verdicts bigint, explained bigint")


@query(f"SELECT CASE WHEN {Q.split('CAST(doc_id AS VARCHAR)')} = 'dev' THEN 'dev' ELSE 'locked' END AS view, count(*) AS n FROM documents GROUP BY 1")
def guard_locked_split(t):
    rows = t.documents.select(F.col("doc_id").alias("question_id"), I.split_of(F.col("doc_id").cast("string")).alias("split"), F.lit("active").alias("status"), F.col("doc_id").alias("created_at"))
    try:
        K.guarded(rows, ("dev", "test"), ("active",))
        raise AssertionError("the exam was open")
    except K.LockedSplit:
        own = K.guarded(rows, ("test",), ("active",), unlocked=True).select(F.lit("locked").alias("view"))
    return K.dev_view(rows).select(F.lit("dev").alias("view")).unionByName(own).groupBy("view").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('match_by', FALSE), ('k', FALSE), ('questions', FALSE), ('budget', FALSE), ('none', TRUE)) v(argument, accepted)")
def validate_arguments(t):
    def accepted(**wrong) -> bool:
        try:
            P.check_arguments(**wrong)
            return True
        except ValueError:
            return False

    tried = {"match_by": {"match_by": "name"}, "k": {"k": 0}, "questions": {"questions": 501}, "budget": {"budget": 0}, "none": {}}
    return t.spark.createDataFrame([(n, accepted(**a)) for n, a in tried.items()], "argument string, accepted boolean")


def _scripts(x: str) -> str:
    return "[s FOR s IN [" + ", ".join(f"CASE WHEN regexp_matches({x}, '\\p{{{n}}}') THEN '{n}' END" for n in X.SCRIPTS) + "] IF s IS NOT NULL]"


@query(f"""WITH q AS (SELECT item_id, text, ['According to the passage, what is ', 'What is ', 'Что '][1 + item_id % 3] || replace(text, chr(10), ' ') AS q FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(q, '(?i){X.PASSAGE_REFERENCE}') THEN 'refers_to_passage' WHEN len([s FOR s IN {_scripts('q')} IF NOT list_contains({_scripts('text')}, s)]) > 0 THEN 'foreign_script' END AS problem FROM q""")
def question_problem(t):
    first = F.element_at(F.array(F.lit("According to the passage, what is "), F.lit("What is "), F.lit("Что ")), (F.col("item_id") % 3 + 1).cast("int"))
    return t.benchmark.select("item_id", X.question_problem(F.concat(first, F.replace("text", F.lit("\n"), F.lit(" "))), F.col("text")).alias("problem"))


# --- model calls ---------------------------------------------------------------------------


class _Moody:
    """A model that refuses some calls for good and some at first."""

    def __init__(self):
        self.seen = set()

    def complete(self, system: str, user: str) -> str:
        if user.endswith("7"):
            raise ValueError("refused")
        if user.endswith("3") and user not in self.seen:
            self.seen.add(user)
            raise OSError("busy")
        return f"{system}:{user}"


@query("SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN 's:' || doc_id END AS reply, CASE WHEN doc_id % 10 = 7 THEN 'refused' END AS error FROM documents")
def udf_completer(t):
    prompts = t.documents.select("doc_id", F.lit("s").alias("system"), F.col("doc_id").cast("string").alias("user"))
    return B.complete(prompts, _Moody, "doc_id", backoff=0.0, parallel=4)


@query(f"WITH {Q.CLOZE} SELECT query_id, len([w FOR w IN string_split(expected, ' ') IF NOT list_contains(string_split(text, ' '), w)]) = 0 AS is_correct, FALSE AS judge_failed FROM questions")
def judge_correctness(t):
    rows = t.questions.select("query_id", F.col("text").alias("question"), "expected", F.col("text").alias("answer"))
    return B.judge_correctness(rows, B.RuleJudge, "query_id").select("query_id", "is_correct", "judge_failed")


@query(f"WITH {Q.CLOZE}, w AS (SELECT query_id, list_distinct(string_split(expected || ' ' || text, ' ')) AS a, string_split(text, ' ') AS c FROM questions), s AS (SELECT query_id, len([x FOR x IN a IF list_contains(c, x)]) / len(a) AS share FROM w) SELECT query_id, share >= 0.8 AS is_grounded, round(share, 3) AS score FROM s")
def judge_groundedness(t):
    rows = t.questions.select("query_id", F.concat("expected", F.lit(" "), "text").alias("answer"), F.array("text").alias("contexts"))
    return B.judge_groundedness(rows, B.RuleJudge, "query_id").select("query_id", "is_grounded", "score")


# --- searches ------------------------------------------------------------------------------

_KNOBS = {"k": {"min": 1, "max": 4, "step": 1}, "mode": ["a", "b"]}


@query("SELECT 8 AS size, k::BIGINT AS k, m AS mode, k = 1 AND m = 'a' AS is_baseline FROM (SELECT unnest(range(1, 5)) AS k), (SELECT unnest(['a', 'b']) AS m)")
def search_space(t):
    space = U.SearchSpace(_KNOBS)
    rows = [(space.size, k, m, space.check({"k": k, "mode": m}) == space.baseline) for k in space.values["k"] for m in space.values["mode"]]
    return t.spark.createDataFrame(rows, "size bigint, k bigint, mode string, is_baseline boolean")


@query("SELECT * FROM (VALUES ('retrieval_miss', 3, 'a'), ('generation_miss', 2, 'b')) v(failure, k, mode)")
def coordinate_ascent(t):
    space, best = U.SearchSpace(_KNOBS), {"k": 2, "mode": "a"}
    moves = [(f, U.coordinate_ascent(space, best, f, ("k",), set())) for f in ("retrieval_miss", "generation_miss")]
    return t.spark.createDataFrame([(f, c["k"], c["mode"]) for f, c in moves], "failure string, k bigint, mode string")


@query("SELECT * FROM (VALUES (0, '{\"k\": 2}', 'why'), (1, '{\"k\": 2}', NULL), (2, NULL, NULL), (3, NULL, NULL)) v(reply, config, rationale)")
def parse_proposal(t):
    replies = ['```json\n{"config": {"k": 2}, "rationale": "why"}\n```', '{"config": {"k": 2}, "rationale": 1}', "k should be 2", '{"config": 2}']
    found = [U.parse_proposal(r) or (None, None) for r in replies]
    return t.spark.createDataFrame([(i, c and json.dumps(c), w) for i, (c, w) in enumerate(found)], "reply bigint, config string, rationale string")


class _Proposer:
    def __init__(self, *replies: str):
        self.replies = list(replies)

    def complete(self, system: str, user: str) -> str:
        return self.replies.pop(0)


@query("SELECT * FROM (VALUES ('at once', 'llm', 4), ('second', 'llm', 3), ('never', 'llm_fallback', 2)) v(attempt, source, k)")
def llm_strategy(t):
    space = U.SearchSpace({"k": [1, 2, 3, 4]})
    ask = lambda tried, *replies: U.llm_proposal(space, _Proposer(*replies), 0, [], {U.key_of({"k": k}) for k in tried})
    rows = {"at once": ask([1], '{"config": {"k": 4}}'), "second": ask([1], '{"config": {"k": 1}}', '{"config": {"k": 3}}'), "never": ask([1, 3, 4], "no", "no")}
    return t.spark.createDataFrame([(n, p["source"], p["config"]["k"]) for n, p in rows.items()], "attempt string, source string, k bigint")


@query(f"""WITH {CASES}, s AS (SELECT k, round(count(*) FILTER (failure_class = 'pass' AND doc_id % 4 < k) * 100.0 / count(*), 2) AS score FROM cases, (SELECT unnest(range(1, 5)) AS k) GROUP BY k)
SELECT k - 1 AS trial_index, k, score, score = max(score) OVER () AS is_best FROM s""")
def tune_loop(t):
    """A search over k, which moves one step at a time while the score rises."""
    cases = t.cases.select("doc_id", "failure_class")

    def evaluate(config: dict):
        found = (F.col("failure_class") == "pass") & (F.col("doc_id") % 4 < config["k"])
        return cases.select(F.when(found, "pass").otherwise("retrieval_miss").alias("failure_class"))

    result = U.tune(U.SearchSpace({"k": [1, 2, 3, 4]}), evaluate, lambda config: 0.0, calls_per_trial=1, budget=100)
    best = result["best"]["trial_index"]
    return t.spark.createDataFrame([(r["trial_index"], r["config"]["k"], r["score"], r["trial_index"] == best) for r in result["trials"]], "trial_index bigint, k bigint, score double, is_best boolean")


@query("SELECT b AS budget, p AS passages, 8 * p + 12 * CAST(ceil(1.2 * p) AS BIGINT) AS total_calls FROM (SELECT unnest([10, 200, 500, 1000]) AS b) JOIN (SELECT unnest(range(1, 31)) AS p) ON p = 1 OR 8 * p + 12 * CAST(ceil(1.2 * p) AS BIGINT) <= b QUALIFY row_number() OVER (PARTITION BY b ORDER BY p DESC) = 1")
def improve_cost(t):
    rows = [(b, P.improve_cost(30, 4, b)) for b in (10, 200, 500, 1000)]
    return t.spark.createDataFrame([(b, c["passages"], c["total_calls"]) for b, c in rows], "budget bigint, passages bigint, total_calls bigint")


# --- scoring a pipeline ----------------------------------------------------------------------


def _half_right():
    """Knows the words that it is asked with, finds only what begins with a letter of the first half, and fails at some."""

    def ask(question: str) -> dict:
        words = question.split(" ")
        if len(words) % 7 == 0:
            raise ValueError("no answer")
        return {"answer": " ".join(words), "retrieved_chunk_ids": ["low" if question[0] < "m" else "other", "x"], "contexts": [question]}

    return ask


_RUN = f"""{Q.CLOZE}, r AS (SELECT query_id, text, string_split(text, ' ') AS w, CASE WHEN query_id % 2 = 0 THEN string_split(text, ' ')[1] ELSE 'zq9' END AS e FROM questions),
s AS (SELECT *, len(w) % 7 = 0 AS failed FROM r), c AS (SELECT query_id, failed, NOT failed AND text < 'm' AS hit, NOT failed AND list_contains(w, e) AS is_correct FROM s)"""


@query(f"""WITH {_RUN} SELECT query_id, hit, is_correct, CASE WHEN hit AND is_correct THEN 'true_pass' WHEN is_correct THEN 'lucky_pass' WHEN hit THEN 'generation_failure' ELSE 'retrieval_failure' END AS verdict,
  CASE WHEN NOT failed THEN 1.0 END AS groundedness, CASE WHEN failed THEN 'no answer' END AS adapter_error, CASE WHEN is_correct AND NOT hit THEN query_id % 2 = 0 END AS confirmed FROM c""")
def run_v1(t):
    expected = F.when(F.col("query_id") % 2 == 0, F.split("text", " ")[0]).otherwise("zq9")
    rows = t.questions.select(F.col("query_id").alias("question_id"), F.col("text").alias("question"), expected.alias("expected"), F.array(F.lit("low")).alias("chunk_ids"))
    cases, _ = W.run_test_set(rows, _half_right, B.RuleJudge, make_alone=_Echo)
    return cases.select(F.col("question_id").alias("query_id"), "hit", "is_correct", "verdict", "groundedness", "adapter_error", "confirmed")


class _Echo:
    def complete(self, system: str, user: str) -> str:
        return user


@query(f"WITH {_RUN} SELECT 'cached' AS mode, count(*) AS n_questions, round(count(*) FILTER (hit AND is_correct) * 100.0 / count(*), 2) AS score, count(*) FILTER (failed) AS adapter_errors FROM c")
def evaluate_cached(t):
    """Half of the questions are scored, then all: the first half isn't asked again."""
    expected = F.when(F.col("query_id") % 2 == 0, F.split("text", " ")[0]).otherwise("zq9")
    rows = t.questions.select(F.col("query_id").alias("question_id"), F.col("text").alias("question"), expected.alias("expected"), F.array(F.lit("low")).alias("chunk_ids"))
    store = K.Store(t.spark, new_path(t.spark, "store"))
    W.evaluate(store, rows.where("question_id % 3 = 0"), _half_right, B.RuleJudge, "c", "v1")
    mode, summary = W.evaluate(store, rows, _half_right, B.RuleJudge, "c", "v1", last_index="v1")
    return summary.select(F.lit(mode).alias("mode"), "n_questions", "score", "adapter_errors")


@query(f"""WITH {Q.CHUNKS}, g AS (SELECT c.doc_id, {Q.bigrams('c.text')} AS g, {Q.bigrams('substr(d.text, 1, 800)')} AS h FROM chunks c JOIN documents d USING (doc_id) WHERE position < 2),
s AS (SELECT doc_id, {Q.match('g', 'h')} >= 0.5 AS found FROM g)
SELECT doc_id, count(*) FILTER (found) / count(*) AS recall, CASE WHEN bool_or(found) THEN 1.0 ELSE 0.0 END AS reciprocal_rank, bool_and(found) AS hit FROM s GROUP BY doc_id""")
def recall_text_mode(t):
    """The first two chunks of each document are gold, and its beginning is what came back."""
    chunks = t.chunks.select("chunk_id", "doc_id", "position", "text")
    gold = chunks.where("position < 2").groupBy("doc_id").agg(F.collect_list("chunk_id").alias("chunk_ids"))
    rows = t.documents.join(gold, "doc_id").select("doc_id", "chunk_ids", F.array(F.substring("text", 1, 800)).alias("contexts"))
    return V.text_recall_at_k(rows, chunks.select("chunk_id", "text"), 5, key="doc_id").select("doc_id", "recall", "reciprocal_rank", "hit")


@query("SELECT 'done' AS state, 3 AS done, count(*) AS n FROM documents")
def background_job(t):
    jobs = Jobs(t.spark)

    def work(job):
        for i in range(3):
            job.progress("counting", i + 1, 3)
        return t.documents.count()

    job = jobs.start("count", work)
    view = jobs.wait()
    return t.spark.createDataFrame([(view["state"], view["done"], job.result)], "state string, done bigint, n bigint")


# --- generation ------------------------------------------------------------------------------


class _Author:
    """Writes from the first words of what it is shown."""

    def complete(self, system: str, user: str) -> str:
        words = user.split("\n")[-1].split(" ")
        if system.startswith("List"):
            return json.dumps({"facts": [{"fact": " ".join(words[:6]), "answer": words[5]}]})
        if system.startswith("Judge"):
            return '{"supported": true, "answerable": true, "unambiguous": true}'
        if system.startswith("Write") and "questions" in system:
            return json.dumps({"questions": [{"question": words[0], "answer": words[1]}]})
        return json.dumps({"question": "Which word comes sixth?"})


_PLAIN = f"plain AS (SELECT item_id, array_to_string({Q.tokens('text')}, ' ') AS text FROM benchmark WHERE len({Q.tokens('text')}) >= 7)"


def _plain(t):
    text = F.array_join(X.tokens_alnum("text"), " ")
    rows = t.benchmark.where(F.size(X.tokens_alnum("text")) >= 7).select(F.concat(F.lit("i"), "item_id").alias("chunk_id"), text.alias("text"))
    return rows.withColumn("hash", F.sha2("text", 256))


@query(f"WITH {_PLAIN} SELECT sha256('i' || item_id || ':0') AS test_id, 'i' || item_id AS chunk_id, string_split(text, ' ')[1] AS question, string_split(text, ' ')[2] AS answer FROM plain")
def generate_v1(t):
    return G.generate_tests(_plain(t), _Author)


@query(f"""WITH {_PLAIN} SELECT sha256(sha256(text) || chr(10) || array_to_string(string_split(text, ' ')[1:6], ' ')) AS question_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS fact, string_split(text, ' ')[6] AS gold_answer,
  'Which word comes sixth?' AS question, {Q.split("'i' || item_id")} AS split, 'active' AS status FROM plain""")
def generate_v2(t):
    found = G.generate_questions(G.single_sources(_plain(t)), _Author, _Author, threshold=2.0)
    return found.select("question_id", "fact", "gold_answer", "question", "split", "status")


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 1 ELSE -1 END::BIGINT AS n, CASE WHEN doc_id % 4 < 2 THEN 'q' || doc_id END AS question FROM documents")
def parse_questions(t):
    from .functions import replies as R

    i = F.col("doc_id")
    good = F.concat(F.lit('{"questions": [{"question": " q'), i, F.lit('", "answer": "a"}, {"question": "", "answer": "a"}, 5]}'))
    reply = F.when(i % 4 < 2, good).when(i % 4 == 2, F.lit('{"questions": []}')).otherwise(F.lit("no"))
    rows = t.documents.select("doc_id", R.parse_questions(reply).alias("p"))
    return rows.select("doc_id", F.coalesce(F.size("p"), F.lit(-1)).alias("n"), F.try_element_at("p", F.lit(1))["question"].alias("question"))
