"""Queries for all operators over the driver's tables, each with its DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import ids as I
from .functions import replies as R
from .functions import text as X
from .operators import cases as E
from .operators import chunking as C
from .operators import history as H
from .operators import planning as P
from .operators import retrieval as V
from .operators import scoring as S
from .operators import versioning as N
from .operators.ordering import numbered
from .plans import audit as A
from .plans import sql as Q
from .sources import corpus as L
from .sources import tables as K
from .streaming.feeds import event_rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as SQL engines count."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*(F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`") for f in df.schema))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: _wide(f(Tables(spark, d)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of a folder, and frames that several queries begin with."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def chunks(self) -> DataFrame:
        return A.corpus_chunks(self.documents)

    @property
    def questions(self) -> DataFrame:
        return A.cloze_questions(self.benchmark)

    @property
    def versions(self) -> tuple[DataFrame, DataFrame]:
        """Two corpus versions by a fixed rule: edited, deleted and added documents."""
        base = self.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text")
        old = base.where("doc_id % 13 <> 0").select("chunk_id", F.sha2("text", 256).alias("hash"))
        edited = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
        new = base.where("doc_id % 17 <> 0").select("chunk_id", F.sha2(edited, 256).alias("hash"))
        return old, new

    @property
    def pool(self) -> DataFrame:
        """A question for every third document, bound to the old version; for some to their neighbour's too."""
        old = self.versions[0]
        return old.where("CAST(chunk_id AS BIGINT) % 3 = 0").select(I.pool_question_id("chunk_id", "hash", F.concat(F.lit("q"), F.col("chunk_id"))).alias("question_key"), "chunk_id", F.col("hash").alias("chunk_hash"))

    @property
    def cases(self) -> DataFrame:
        """Five runs over questions, with outcomes by a fixed rule."""
        i = F.col("doc_id")
        rows = self.documents.select(
            i, (i % 5).alias("run_id"), F.floor(i / 5).alias("question_id"), ((i * 7 + F.floor(i / 5) * 3) % 10 < 6).alias("hit"), ((i * 13 + F.floor(i / 5)) % 10 < 5).alias("is_correct"),
            F.when(i % 4 != 0, (i % 11) / 10.0).alias("groundedness"), (i % 17 == 0).alias("judge_failed"), F.when(i % 19 == 0, "adapter raised").alias("adapter_error"), ((i % 5) / 4.0).alias("recall"), (1.0 / (1 + i % 4)).alias("reciprocal_rank"),
        )
        rows = rows.withColumns({"verdict": S.verdict(F.col("hit"), F.col("is_correct")), "failure_class": S.failure_class(F.col("hit"), F.col("is_correct"))})
        return rows.withColumn("confirmed", F.when((F.col("verdict") == "lucky_pass") & (i % 2 == 0), i % 3 == 0))

    @property
    def runs(self) -> DataFrame:
        return self.cases.groupBy("run_id").agg(F.max("doc_id").alias("last")).select("run_id", F.when(F.col("run_id") < 4, "check").otherwise("tune").alias("kind"), F.col("run_id").alias("created_at"), F.when(F.col("run_id") % 2 == 0, "a").otherwise("b").alias("fingerprint"))

    @property
    def trials(self) -> DataFrame:
        """Orders as trials: a search for each priority."""
        place = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
        return self.orders.select(F.col("o_orderpriority").alias("tune_id"), (F.row_number().over(place) - 1).alias("trial_index"), F.floor(F.col("o_totalprice") % 100).cast("double").alias("score"), F.col("o_orderstatus").alias("config"))


VERDICT = "CASE WHEN hit AND is_correct THEN 'true_pass' WHEN is_correct THEN 'lucky_pass' WHEN hit THEN 'generation_failure' ELSE 'retrieval_failure' END"
CASES = f"""raw AS (SELECT doc_id AS i, doc_id // 5 AS q FROM documents),
base AS (SELECT i AS doc_id, i % 5 AS run_id, q AS question_id, (i * 7 + q * 3) % 10 < 6 AS hit, (i * 13 + q) % 10 < 5 AS is_correct, CASE WHEN i % 4 <> 0 THEN (i % 11) / 10.0 END AS groundedness,
  i % 17 = 0 AS judge_failed, CASE WHEN i % 19 = 0 THEN 'adapter raised' END AS adapter_error, (i % 5) / 4.0 AS recall, 1.0 / (1 + i % 4) AS reciprocal_rank FROM raw),
cases AS (SELECT *, {VERDICT} AS verdict, CASE WHEN NOT hit THEN 'retrieval_miss' WHEN is_correct THEN 'pass' ELSE 'generation_miss' END AS failure_class,
  CASE WHEN NOT hit AND is_correct AND doc_id % 2 = 0 THEN doc_id % 3 = 0 END AS confirmed FROM base)"""
RUNS = "runs AS (SELECT DISTINCT run_id, CASE WHEN run_id < 4 THEN 'check' ELSE 'tune' END AS kind, run_id AS created_at, CASE WHEN run_id % 2 = 0 THEN 'a' ELSE 'b' END AS fingerprint FROM cases)"
VERSIONS = """old AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0),
new AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END) AS hash FROM documents WHERE doc_id % 17 <> 0)"""
POOL = VERSIONS + ", pool AS (SELECT sha256(chunk_id || '@' || hash || chr(10) || 'q' || chunk_id) AS question_key, chunk_id, hash AS chunk_hash FROM old WHERE CAST(chunk_id AS BIGINT) % 3 = 0)"
TRIALS = "trials AS (SELECT o_orderpriority AS tune_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS trial_index, floor(o_totalprice % 100) AS score, o_orderstatus AS config FROM orders)"


# --- flagship ----------------------------------------------------------------------------


@query(f"WITH {Q.AUDIT} SELECT * REPLACE (coalesce(match_rank, -1) AS match_rank) FROM cases")
def audit_verdicts(t):
    return A.audit_cases(t.documents, t.benchmark).withColumn("match_rank", F.coalesce("match_rank", F.lit(-1)))


@query(f"""WITH {Q.AUDIT} SELECT count(*) AS total_cases, {', '.join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in S.VERDICTS)},
  round(count(*) FILTER (hit) / count(*), 4) AS retrieval_hit_rate, round(count(*) FILTER (is_correct) / count(*), 4) AS answer_correctness_rate FROM cases""")
def audit_summary(t):
    cases = A.audit_cases(t.documents, t.benchmark).withColumns({"groundedness": F.lit(None).cast("double"), "judge_failed": F.lit(False), "confirmed": F.lit(None).cast("boolean")})
    return S.run_summary(cases).select("total_cases", *(f"n_{v}" for v in S.VERDICTS), "retrieval_hit_rate", "answer_correctness_rate")


# --- sources -----------------------------------------------------------------------------


@query("SELECT 'c' || doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS position, text, lang, source FROM documents WHERE trim(text, ' ') <> ''")
def scan_jsonl_corpus(t):
    lines = t.documents.select(F.col("doc_id").alias("line"), F.to_json(F.struct(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("position"), "text", "lang", "source", "n_chars")).alias("value"))
    rows = L.parse_jsonl(lines).where("problem IS NULL")
    return rows.select("chunk_id", "doc_id", "position", "text", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query("SELECT line, CASE line % 5 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'missing chunk_id' WHEN 3 THEN 'blank text' END AS problem FROM (SELECT item_id AS line FROM benchmark)")
def scan_jsonl_problems(t):
    value = F.expr("CASE item_id % 5 WHEN 0 THEN '{\"chunk_id\": ' WHEN 1 THEN '[1]' WHEN 2 THEN '{\"text\": \"x\"}' WHEN 3 THEN '{\"chunk_id\": \"a\", \"text\": \"  \"}' ELSE '{\"chunk_id\": \"a\", \"text\": \"x\"}' END")
    return L.parse_jsonl(t.benchmark.select(F.col("item_id").alias("line"), value.alias("value"))).select("line", "problem")


@query(f"WITH {Q.CHUNKS} SELECT d.source || '/' || d.doc_id || '.md#' || c.position AS chunk_id, d.source || '/' || d.doc_id || '.md' AS doc_id, c.position, c.text FROM chunks c JOIN documents d USING (doc_id)")
def scan_dir_corpus(t):
    return L.scan_dir_corpus(t.documents.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "text"))


@query("SELECT source AS chunk_id, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def load_corpus_duplicates(t):
    return N.duplicate_keys(t.documents.select(F.col("source").alias("chunk_id")), "chunk_id")


@query("SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def parse_timestamp(t):
    return t.events.select("event_id", X.parse_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("parsed"))


# --- sinks -------------------------------------------------------------------------------


@query(f"WITH {VERSIONS} SELECT * FROM new WHERE chunk_id NOT IN (SELECT chunk_id FROM old)")
def sink_insert_ignore(t):
    old, new = t.versions
    return N.insert_ignore(old, new, ["chunk_id"])


@query(f"WITH {VERSIONS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)")
def sink_upsert(t):
    old, new = t.versions
    return N.upsert(old, new, ["chunk_id"])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, lang, n_chars + 1 FROM documents WHERE lang = 'de' AND doc_id % 2 = 0")
def sink_replace_by_key(t):
    rows = t.documents.select("doc_id", "lang", "n_chars")
    return N.replace_by_key(rows, rows.where("lang = 'de' AND doc_id % 2 = 0").withColumn("n_chars", F.col("n_chars") + 1), "lang")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'retired' ELSE 'active' END AS status, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS was_changed FROM documents")
def sink_update_status(t):
    rows = t.documents.select("doc_id", F.lit("active").alias("status"))
    return N.update_status(rows, t.labels.where("toxic = 1"), "doc_id", "retired")


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def sink_replace_all(t):
    from .plans.scratch import new_path

    store = K.Store(t.spark, new_path(t.spark, "store"))
    store.replace("documents", t.documents.limit(0))
    store.replace("documents", t.documents, partition_by=["lang"])
    return store.read("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, CASE WHEN (doc_id % 2 = 0) THEN 'a' ELSE 'b' END AS verdict, lang, len(text) AS n FROM documents")
def sink_json_lossless(t):
    nested = t.documents.select("doc_id", F.struct(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("verdict"), F.array("lang").alias("langs"), "text").alias("r"))
    back = E.from_json_rows(E.to_json_rows(nested, ["r"]), nested.schema, ["r"])
    return back.select("doc_id", "r.verdict", F.col("r.langs")[0].alias("lang"), F.length("r.text").alias("n"))


@query(f"""WITH q AS (SELECT doc_id, [CAST(doc_id AS VARCHAR), CAST(doc_id % 7 AS VARCHAR)] AS c FROM documents),
s AS (SELECT doc_id, {Q.split('c[1]')} AS a, {Q.split('c[2]')} AS b FROM q) SELECT doc_id AS question_id, CASE WHEN a = b THEN a END AS split, CASE WHEN a = b THEN 'active' ELSE 'rejected' END AS status FROM s""")
def sink_schema_migrate(t):
    q = t.documents.select(F.col("doc_id").alias("question_id"), F.array(F.col("doc_id").cast("string"), (F.col("doc_id") % 7).cast("string")).alias("chunk_ids"), F.lit("dev").alias("split"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("reject_reason"))
    return N.migrate_splits(q, q.select("question_id"))[0].select("question_id", "split", "status")


# --- chunking and identity ---------------------------------------------------------------


@query(f"WITH {Q.CHUNKS} SELECT * FROM chunks")
def chunk_fixed(t):
    return t.chunks


@query("""WITH w AS (SELECT doc_id, [x FOR x IN string_split(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ') IF x <> ''] AS ws FROM documents)
SELECT doc_id, pos AS position, array_to_string(ws[pos * 100 + 1 : pos * 100 + 120], ' ') AS text FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, CAST(ceil((len(ws) - 20) / 100.0) AS BIGINT)))) AS pos FROM w WHERE len(ws) > 0)""")
def chunk_words(t):
    return C.chunk_words(t.documents.select("doc_id", "text")).select("doc_id", "position", "text")


@query("""WITH p AS (SELECT doc_id, [x FOR x IN [trim(regexp_replace(y, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') FOR y IN regexp_split_to_array(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n')] IF x <> ''] AS ps FROM documents WHERE text IS NOT NULL)
SELECT doc_id, pos - 1 AS position, ps[pos] AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS pos FROM p)""")
def chunk_paragraphs(t):
    return C.chunk_paragraphs(t.documents.select("doc_id", "text"))


@query()
def chunk_pack(t):
    return C.chunk_pack(t.documents.select("doc_id", "text"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def hash_content(t):
    return t.documents.select("doc_id", I.hash_content("text").alias("content_hash"))


@query(f"WITH {Q.CHUNKS} SELECT sha256(doc_id || ':' || position || ':' || text) AS id, chunk_id FROM chunks")
def id_chunk(t):
    return t.chunks.select(I.chunk_id("doc_id", "position", "text").alias("id"), "chunk_id")


@query(
    "SELECT item_id, sha256(sha256(text) || '|' || sha256('b') || chr(10) || trim(text, ' ')) AS question_id, sha256('c' || item_id || ':' || 3) AS test_id, "
    "sha256('c' || item_id || '@' || sha256(text) || chr(10) || trim(text, ' ')) AS pool_id FROM benchmark"
)
def id_question(t):
    chunk, h = F.concat(F.lit("c"), "item_id"), I.hash_content("text")
    ids = I.question_id(F.array(h, F.sha2(F.lit("b"), 256)), "text"), I.test_case_id(chunk, F.lit(3)), I.pool_question_id(chunk, h, "text")
    return t.benchmark.select("item_id", *(c.alias(n) for c, n in zip(ids, ("question_id", "test_id", "pool_id"))))


@query("SELECT item_id, array_to_string(list_sort(['z' || item_id || '@' || sha256(text), 'a' || item_id || '@h']), '+') AS source_key FROM benchmark")
def id_source(t):
    return t.benchmark.select("item_id", I.source_key(F.array(F.concat(F.lit("z"), "item_id"), F.concat(F.lit("a"), "item_id")), F.array(F.sha2("text", 256), F.lit("h"))).alias("source_key"))


@query(Q.tree_hash("documents", "sha256(text)", "source", "corpus_hash", distinct=False))
def corpus_hash(t):
    return I.corpus_hash(t.documents.select("source", F.sha2("text", 256).alias("content_hash")), by=["source"])


@query(Q.tree_hash("documents", "sha256(text)", "source", "index_version"))
def index_version(t):
    return I.index_version(t.documents.select("source", F.sha2("text", 256).alias("hash")), by=["source"])


@query(Q.tree_hash("(SELECT doc_id % 5 AS run_id, CAST(doc_id // 5 AS VARCHAR) AS k FROM documents)", "k", "run_id", "question_set"))
def id_question_set(t):
    keys = t.cases.select("run_id", F.col("question_id").cast("string").alias("question_key"))
    return I.question_set_id(keys, by=["run_id"]).withColumnRenamed("question_set_id", "question_set")


@query("""SELECT p AS k, sha256('{"adapter_sha256": "x", "config": {"k": ' || p || '}, "judge_model": "m", "k": 5, "scoring_version": 1}') AS config_hash FROM (SELECT unnest(range(1, 6)) AS p)""")
def config_hash(t):
    return t.spark.createDataFrame([(k, I.config_hash({"k": k}, "x", "m", 5)) for k in range(1, 6)], "k bigint, config_hash string")


@query(f"WITH {Q.CHUNKS} SELECT chunk_id, {Q.split('chunk_id')} AS split FROM chunks")
def split_assign(t):
    return t.chunks.select("chunk_id", I.split_of("chunk_id").alias("split"))


@query(f"SELECT doc_id, CASE WHEN a = b THEN a END AS split FROM (SELECT doc_id, {Q.split('CAST(doc_id AS VARCHAR)')} AS a, {Q.split('CAST(doc_id + 1 AS VARCHAR)')} AS b FROM documents)")
def split_multi(t):
    return t.documents.select("doc_id", I.split_of_all(F.array(F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string"))).alias("split"))


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT DISTINCT doc_id, CAST(1 AS BIGINT) AS n_questions FROM d JOIN (SELECT unnest(range(0, 60)) AS j) ON i = (j * n) // 60")
def spread(t):
    return P.spread(t.documents.select("doc_id"), 60, ["doc_id"])


@query("WITH d AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) SELECT item_id, CAST(1500 // n + CASE WHEN i < 1500 % n THEN 1 ELSE 0 END AS BIGINT) AS n_questions FROM d")
def spread_many(t):
    return P.spread(t.benchmark.select("item_id"), 1500, ["item_id"])


# --- filters -----------------------------------------------------------------------------


@query(f"SELECT doc_id, lang, {Q.split('CAST(doc_id AS VARCHAR)')} AS split FROM documents WHERE lang IN ('en', 'de') AND split = 'dev'")
def filter_status_split(t):
    q = t.documents.select("doc_id", "lang", I.split_of(F.col("doc_id").cast("string")).alias("split"), F.col("lang").alias("status"), F.col("doc_id").alias("created_at"), F.col("doc_id").alias("question_id"))
    return K.guarded(q, ("dev",), ("en", "de")).select("doc_id", "lang", "split")


@query(f"WITH {POOL} SELECT chunk_id FROM new WHERE chunk_id NOT IN (SELECT chunk_id FROM pool) AND chunk_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def filter_pending(t):
    source = t.versions[1].select("chunk_id", F.col("chunk_id").alias("source_key"))
    return P.pending_sources(source, t.pool.select(F.col("chunk_id").alias("source_key")), t.labels.select(F.col("doc_id").cast("string").alias("source_key"))).select("chunk_id")


@query("""SELECT item_id, a <> '' AND len(string_split(f, ' ')) >= 3 AND f <> a AND contains(' ' || regexp_replace(f, '[^a-z0-9]', ' ', 'g') || ' ', ' ' || regexp_replace(a, '[^a-z0-9]', ' ', 'g') || ' ') AS usable
FROM (SELECT item_id, trim(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), ' .,;:!?"''') AS f, trim(trim(regexp_replace(lower(CASE WHEN item_id % 3 = 0 THEN text WHEN item_id % 3 = 1 THEN string_split(text, ' ')[2] ELSE 'xq7' END), '\\s+', ' ', 'g'), ' '), ' .,;:!?"''') AS a FROM benchmark)""")
def is_usable_fact(t):
    answer = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, F.split("text", " ")[1]).otherwise("xq7")
    return t.benchmark.select("item_id", X.is_usable_fact(F.col("text"), answer).alias("usable"))


_TIMES = "['What happened last week?', 'Who is it now?', 'What came two years ago?', 'Which one is the latest?', 'What is a lasting weakness?', 'Who knows the nowhere man?', 'When was it built?', 'What is due at the moment?']"


@query(f"SELECT item_id, nullif(regexp_extract({_TIMES}[1 + item_id % 8], '(?i)\\b(now|latest|last\\s+week|two\\s+years\\s+ago|at\\s+the\\s+moment)\\b', 1), '') AS found FROM benchmark")
def relative_time(t):
    texts = F.expr("array" + _TIMES.replace("[", "(").replace("]", ")"))
    return t.benchmark.select("item_id", X.relative_time(F.element_at(texts, (F.col("item_id") % 8 + 1).cast("int"))).alias("found"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'cross_split' WHEN (doc_id % 10) / 10.0 > 0.5 THEN 'too_lexical' WHEN doc_id % 7 = 0 THEN 'relative_time' WHEN doc_id % 13 = 0 THEN 'verifier_unparseable'
  WHEN doc_id % 2 = 1 THEN 'unsupported' WHEN doc_id % 3 = 1 THEN 'unanswerable' WHEN doc_id % 5 = 2 THEN 'ambiguous' END AS reject_reason FROM documents""")
def reject_reason(t):
    i = F.col("doc_id")
    said = lambda m, bad: F.when(i % 13 != 0, i % m != bad)
    rows = t.documents.select("doc_id", F.when(i % 11 != 0, "dev").alias("split"), ((i % 10) / 10.0).alias("overlap"), F.when(i % 7 == 0, "What is new today?").otherwise("What is it?").alias("question"), said(2, 1).alias("supported"), said(3, 1).alias("answerable"), said(5, 2).alias("unambiguous"))
    return P.reject_reason(rows).select("doc_id", "reject_reason")


# --- text --------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({Q.tokens('text')}) AS n, sha256(array_to_string({Q.tokens('text')}, ' ')) AS h FROM documents")
def tokens_alnum(t):
    return t.documents.select("doc_id", F.size(X.tokens_alnum("text")).alias("n"), F.sha2(F.array_join(X.tokens_alnum("text"), " "), 256).alias("h"))


@query(f"SELECT doc_id, sha256(array_to_string({Q.fold(Q.numeric('text'))}, ' ')) AS h FROM documents")
def tokens_numeric(t):
    return t.documents.select("doc_id", F.sha2(F.array_join(X.tokens_numeric("text"), " "), 256).alias("h"))


@query(f"SELECT doc_id, sha256(array_to_string(list_sort({Q.content('text')}), ' ')) AS h FROM documents")
def content_tokens(t):
    return t.documents.select("doc_id", F.sha2(F.array_join(F.array_sort(X.content_tokens("text")), " "), 256).alias("h"))


@query(f"SELECT doc_id, len({Q.bigrams('text')}) AS n, sha256(array_to_string(list_sort({Q.bigrams('text')}), '|')) AS h FROM documents")
def bigrams(t):
    return t.documents.select("doc_id", F.size(X.bigrams("text")).alias("n"), F.sha2(F.array_join(F.array_sort(X.bigrams("text")), "|"), 256).alias("h"))


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace({Q.folded('lower(text)')}, '^[ .,;:!?\"'']+', ''), '[ .,;:!?\"'']+$', '')) AS answer_sha256 FROM documents")
def normalize_answer(t):
    return t.documents.select("doc_id", F.sha2(X.normalize_answer("text"), 256).alias("answer_sha256"))


@query(f"""WITH p AS (SELECT a.item_id AS a, b.item_id AS b, {Q.content('a.text')} AS x, {Q.content('b.text')} AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT a, b, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE {Q.shared('x', 'y')}::DOUBLE / len(list_distinct(x || y)) END, 6) AS score FROM p""")
def jaccard(t):
    a, b = t.benchmark.select(F.col("item_id").alias("a"), X.content_tokens("text").alias("x")), t.benchmark.select(F.col("item_id").alias("b"), X.content_tokens("text").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(X.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


@query()
def name_tokens(t):
    return t.benchmark.select("item_id", F.array_join(F.array_sort(X.name_tokens("text")), " ").alias("names"))


@query()
def lexical_overlap(t):
    return t.questions.select("query_id", F.round(X.lexical_overlap("text", "gold"), 4).alias("overlap"))


@query(f"SELECT doc_id, unnest(range(0, len(s))) AS position, unnest(s) AS sentence FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents WHERE text IS NOT NULL)")
def sentences(t):
    return t.documents.select("doc_id", F.posexplode(X.sentences("text")).alias("position", "sentence"))


@query()
def answer_span(t):
    return t.documents.select("doc_id", X.answer_span("text").alias("answer"))


@query(f"SELECT doc_id, {Q.excerpt('text', chr(39) + 'the' + chr(39))} AS excerpt FROM documents")
def excerpt(t):
    return t.documents.select("doc_id", X.excerpt("text", F.lit("the")).alias("excerpt"))


@query(f"SELECT doc_id, {Q.highlight('text', chr(39) + 'the' + chr(39))} AS html FROM documents")
def highlight(t):
    return t.documents.select("doc_id", X.highlight("text", F.lit("the")).alias("html"))


@query(f"WITH p AS (SELECT item_id, {Q.fold(Q.numeric('text'))} AS x FROM benchmark) SELECT a.item_id AS a, contains(' ' || array_to_string(a.x, ' ') || ' ', ' ' || array_to_string(b.x[1:3], ' ') || ' ') AS found FROM p a JOIN p b ON b.item_id = a.item_id + a.item_id % 2")
def contains_normalized(t):
    rows = t.benchmark.select("item_id", "text")
    other = rows.select(F.col("item_id").alias("b"), F.array_join(F.slice(X.tokens_numeric("text"), 1, 3), " ").alias("part"))
    return rows.join(other, F.col("b") == F.col("item_id") + F.col("item_id") % 2).select(F.col("item_id").alias("a"), X.contains_normalized("text", "part").alias("found"))


# --- replies -----------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN doc_id % 2 = 0 END AS is_correct, CASE WHEN doc_id % 6 < 4 AND doc_id % 6 <> 3 THEN (doc_id % 10) / 10.0 WHEN doc_id % 6 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 1.0 END END AS score FROM documents""")
def parse_correctness(t):
    i, flag = F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false")
    score = (i % 10 / 10.0).cast("string")
    reply = (
        F.when(i % 6 == 4, F.lit('{"is_correct": "yes", "score": 1}'))
        .when(i % 6 == 5, F.concat(F.lit('{"is_correct": '), flag))
        .when(i % 6 == 3, F.concat(F.lit('{"is_correct": '), flag, F.lit(', "score": true, "rationale": null}')))
        .otherwise(F.concat(F.lit('{"is_correct": '), flag, F.lit(', "score": '), score, F.lit(', "rationale": "r"}')))
    )
    return t.documents.select("doc_id", R.parse_correctness(reply).alias("p")).select("doc_id", "p.is_correct", "p.score")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN doc_id % 2 = 0 END AS is_grounded FROM documents")
def parse_groundedness(t):
    flag = F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false")
    reply = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit('{"is_grounded": '), flag, F.lit(', "rationale": 5}'))).otherwise(F.concat(F.lit('{"is_grounded": '), flag, F.lit("}")))
    return t.documents.select("doc_id", R.parse_groundedness(reply).alias("p")).select("doc_id", "p.is_grounded")


@query("SELECT doc_id, CASE WHEN doc_id % 6 <> 5 THEN 'q' || doc_id END AS question FROM documents")
def json_object_lenient(t):
    body = F.concat(F.lit('{"question": "q'), "doc_id", F.lit('"'))
    shapes = [F.concat(body, F.lit("}")), F.concat(F.lit("```json\n"), body, F.lit("}\n```")), F.concat(F.lit("Sure: "), body, F.lit("} Done.")), body, F.concat(body, F.lit(', "x": [1, 2')), F.lit('{"question": "cut')]
    reply = F.element_at(F.array(*shapes), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", F.try_variant_get(R.json_object(reply), "$.question", "string").alias("question"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'Who?' WHEN item_id % 3 = 1 THEN 'What is it?' END AS question, CASE WHEN item_id % 2 = 0 THEN item_id % 4 = 0 END AS supported FROM benchmark")
def parse_question_verify(t):
    i = F.col("item_id")
    reply = F.when(i % 3 == 0, F.lit('{"question": " Who? "}')).when(i % 3 == 1, F.lit('"What is it?"')).otherwise(F.lit("two\nlines"))
    verify = F.when(i % 2 == 0, F.concat(F.lit('{"supported": '), F.when(i % 4 == 0, "true").otherwise("false"), F.lit(', "answerable": true, "unambiguous": false}'))).otherwise(F.lit('{"supported": "yes", "answerable": true, "unambiguous": true}'))
    return t.benchmark.select("item_id", R.parse_question(reply).alias("question"), R.parse_verification(verify).alias("v")).select("item_id", "question", F.col("v.supported").alias("supported"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 1 WHEN item_id % 3 = 1 THEN 0 ELSE -1 END::BIGINT AS n_facts FROM benchmark")
def parse_facts(t):
    i = F.col("item_id")
    reply = F.when(i % 3 == 0, F.lit('{"facts": [{"fact": "The mill has 12 wheels", "answer": 12}, {"fact": "12", "answer": "12"}]}')).when(i % 3 == 1, F.lit('{"facts": []}')).otherwise(F.lit('{"facts": 3}'))
    return t.benchmark.select("item_id", F.size(R.parse_facts(reply)).alias("n")).select("item_id", F.coalesce("n", F.lit(-1)).alias("n_facts"))


# --- joins -------------------------------------------------------------------------------


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def join_case_to_question(t):
    cases = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id")
    return E.cases_with_questions(cases, t.labels.select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_case_left(t):
    return E.cases_or_placeholder(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), "doc_id", "quality", -1)


@query(f"WITH {Q.CHUNKS} SELECT chunk_id, sha256(text) AS h FROM chunks WHERE position = 0")
def join_gold_text(t):
    chunks = t.chunks
    return E.gold_texts(chunks.where("position = 0").select("chunk_id"), chunks).select("chunk_id", F.sha2("text", 256).alias("h"))


@query(f"WITH {VERSIONS} SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'changed' ELSE 'unchanged' END AS change FROM old o FULL JOIN new n ON o.chunk_id = n.chunk_id")
def diff_corpus(t):
    return N.diff_corpus(*t.versions)


@query(f"WITH {POOL}, q AS (SELECT p.*, n.hash AS now FROM pool p LEFT JOIN new n USING (chunk_id)) SELECT question_key AS question_id, CASE WHEN CAST(chunk_id AS BIGINT) % 7 = 0 THEN 'rejected' WHEN now = chunk_hash THEN 'active' ELSE 'stale' END AS status FROM q")
def staleness(t):
    q = t.pool.select(F.col("question_key").alias("question_id"), F.array("chunk_id").alias("chunk_ids"), F.array("chunk_hash").alias("chunk_hashes"), F.when(F.col("chunk_id").cast("bigint") % 7 == 0, "rejected").otherwise("active").alias("status"))
    return N.staleness(q, t.versions[1]).select("question_id", "status")


@query(f"WITH {CASES} SELECT a.run_id, count(*) AS shared FROM cases a JOIN cases b ON a.question_id = b.question_id AND b.run_id = a.run_id - 1 GROUP BY a.run_id")
def shared_questions(t):
    previous = t.runs.select("run_id", (F.col("run_id") - 1).alias("prev_run_id"))
    return E.shared_questions(t.cases, previous)


@query(f"WITH {CASES} SELECT d.doc_id, c.verdict, c.verdict IS NULL AS to_run FROM documents d LEFT JOIN (SELECT * FROM cases WHERE run_id = 2 AND doc_id % 4 = 2) c ON d.doc_id = c.question_id")
def cache_lookup(t):
    kept = t.cases.select("question_id", "verdict", F.concat(F.lit("c"), "run_id").alias("config_hash"), F.concat(F.lit("v"), F.col("doc_id") % 4).alias("index_version"))
    return E.cache_lookup(t.documents.select(F.col("doc_id").alias("question_id")), kept, "c2", "v2").select(F.col("question_id").alias("doc_id"), "verdict", "to_run")


_GOT = "[CAST(doc_id + 1 AS VARCHAR), CAST(doc_id + doc_id % 3 AS VARCHAR), CAST(doc_id AS VARCHAR), 'x']"


def _got(t):
    i = F.col("doc_id")
    return t.documents.select("doc_id", F.array(i.cast("string"), (i + 2).cast("string")).alias("gold"), F.array((i + 1).cast("string"), (i + i % 3).cast("string"), i.cast("string"), F.lit("x")).alias("got"))


@query(f"SELECT doc_id, list_position({_GOT}, CAST(doc_id AS VARCHAR))::BIGINT - 1 AS rank FROM documents")
def match_by_id(t):
    return _got(t).select("doc_id", V.id_rank(F.col("gold")[0], F.col("got")).alias("rank"))


@query(f"""WITH g AS (SELECT doc_id, [CAST(doc_id AS VARCHAR), CAST(doc_id + 2 AS VARCHAR)] AS gold, {_GOT}[1:2] AS top FROM documents), s AS (SELECT *, {Q.shared('gold', 'top')} AS f, list_min([i FOR i IN [1, 2] IF list_contains(gold, top[i])]) AS r FROM g)
SELECT doc_id, f / 2.0 AS recall, coalesce(1.0 / r, 0.0) AS reciprocal_rank, f = 2 AS hit FROM s""")
def recall_mrr_at_k(t):
    rows = _got(t)
    m = V.recall_at_k(F.col("gold"), F.col("got"), 2)
    return rows.select("doc_id", *(c.alias(n) for n, c in m.items()))


@query(f"WITH {Q.CHUNKS}, {Q.CLOZE}, g AS (SELECT query_id, {Q.bigrams('gold')} AS g FROM questions), h AS (SELECT chunk_id, {Q.bigrams('text')} AS h FROM chunks), gu AS (SELECT query_id, len(g) AS m, unnest(g) AS b FROM g), hu AS (SELECT chunk_id, len(h) AS n, unnest(h) AS b FROM h) SELECT query_id, chunk_id, round(count(*) / greatest(least(n, m), 8), 4) AS score FROM gu JOIN hu USING (b) GROUP BY query_id, chunk_id, n, m HAVING score >= 0.5")
def match_by_text(t):
    return V.corpus_matches(t.chunks, t.questions.select("query_id", F.col("gold").alias("text")))


@query(f"WITH {Q.CHUNKS}, {Q.CLOZE}, {Q.BM25} {Q.top('scored', 5)}")
def retrieve_bm25(t):
    return V.retrieve(t.chunks, t.questions, 5)


_WORDS = "list_distinct([w FOR w IN " + Q.tokens("text") + f" IF NOT list_contains({Q.STOP}, w)])"
_OVERLAP = f"overlap AS (SELECT query_id, chunk_id, count(*)::DOUBLE AS score FROM (SELECT chunk_id, unnest({_WORDS}) AS w FROM chunks) JOIN (SELECT query_id, unnest({_WORDS}) AS w FROM questions) USING (w) GROUP BY ALL)"


@query(f"WITH {Q.CHUNKS}, {Q.CLOZE}, {_OVERLAP}, every AS (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score FROM (SELECT query_id, chunk_id FROM questions, chunks) LEFT JOIN overlap USING (query_id, chunk_id)) {Q.top('every', 5)}")
def retrieve_overlap(t):
    return V.retrieve(t.chunks, t.questions, 5, "overlap")


def _grams(table: str, key: str) -> str:
    padded = f"' ' || array_to_string({Q.tokens('text')}, ' ') || ' '"
    return f"SELECT *, sqrt(sum(times * times) OVER (PARTITION BY {key})) AS norm FROM (SELECT {key}, gram, count(*) AS times FROM (SELECT {key}, unnest([substr(p, i, 3) FOR i IN range(1, greatest(length(p) - 2, 1) + 1)]) AS gram FROM (SELECT {key}, {padded} AS p FROM {table})) GROUP BY ALL)"


_TRIGRAM = f"cg AS ({_grams('chunks', 'chunk_id')}), qg AS ({_grams('questions', 'query_id')}), cosine AS (SELECT query_id, chunk_id, round(sum(c.times * q.times) / (any_value(c.norm) * any_value(q.norm)), 6) AS score FROM cg c JOIN qg q USING (gram) GROUP BY query_id, chunk_id)"


@query(f"WITH {Q.CHUNKS}, {Q.CLOZE}, {_TRIGRAM} {Q.top('cosine', 5)}")
def trigram_cosine(t):
    return V.retrieve(t.chunks, t.questions, 5, "trigram")


_HYBRID = f"hyb AS (SELECT query_id, chunk_id, round(0.6 * coalesce(lex, 0) + 0.4 * coalesce(c.score, 0), 6) AS score FROM (SELECT query_id, chunk_id, score / nullif(max(score) OVER (PARTITION BY query_id), 0) AS lex FROM scored) s FULL JOIN cosine c USING (query_id, chunk_id))"


@query(f"WITH {Q.CHUNKS}, {Q.CLOZE}, {Q.BM25}, {_TRIGRAM}, {_HYBRID} {Q.top('hyb', 5)}")
def retrieve_hybrid(t):
    return V.retrieve(t.chunks, t.questions, 5, "hybrid", 0.4)


@query(f"""WITH {Q.CHUNKS}, {Q.CLOZE}, {Q.BM25}, r AS ({Q.top('scored', 20)}),
s AS (SELECT r.query_id, r.chunk_id, r.rank AS before, c.doc_id, round({Q.shared('x', 'y')}::DOUBLE / greatest(len(x), 1), 6) AS score FROM r JOIN (SELECT query_id, list_distinct({Q.tokens('text')}) AS x FROM questions) USING (query_id) JOIN (SELECT chunk_id, doc_id, list_distinct({Q.tokens('text')}) AS y FROM chunks) c USING (chunk_id)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, before) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank, chunk_id, score FROM b QUALIFY rank <= 5""")
def rerank(t):
    ranked = V.retrieve(t.chunks, t.questions, 20)
    return V.rerank(ranked, t.chunks, t.questions, 5, source="doc_id")


@query(f"WITH {Q.CHUNKS}, {Q.CLOZE}, {Q.BM25}, {Q.DEGRADED} SELECT query_id, rank, chunk_id, swap FROM degraded")
def retrieve_degraded(t):
    ids = numbered(t.chunks.select("chunk_id", "doc_id", "position"), ["doc_id", "position"])
    return V.degrade(V.retrieve(t.chunks, t.questions, 5), ids)


@query(f"""WITH {Q.CHUNKS}, c AS (SELECT chunk_id, doc_id, position, {Q.content('text')} AS t, {Q.split('chunk_id')} AS s FROM chunks),
n AS (SELECT *, lead(chunk_id) OVER w AS b, lead(t) OVER w AS u, lead(s) OVER w AS v FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY position))
SELECT chunk_id AS chunk_a, b AS chunk_b, round(1 + CASE WHEN len(t) = 0 OR len(u) = 0 THEN 0.0 ELSE {Q.shared('t', 'u')}::DOUBLE / len(list_distinct(t || u)) END, 6) AS score FROM n WHERE b IS NOT NULL AND s = v""")
def candidate_pairs(t):
    return P.candidate_pairs(t.chunks.withColumn("tokens", X.content_tokens("text")))


@query(f"""WITH c AS (SELECT CAST(item_id AS VARCHAR) AS k, item_id, {Q.content('text')} AS t, {Q.split('CAST(item_id AS VARCHAR)')} AS s FROM benchmark),
p AS (SELECT a.k AS chunk_a, b.k AS chunk_b, {Q.shared('a.t', 'b.t')}::DOUBLE AS i, len(list_distinct(a.t || b.t)) AS u FROM c a JOIN c b ON a.k < b.k AND a.s = b.s)
SELECT chunk_a, chunk_b, round(i / u, 6) AS score FROM p WHERE u > 0 AND i / u >= 0.15""")
def candidate_pairs_similar(t):
    rows = t.benchmark.select(F.col("item_id").cast("string").alias("chunk_id"), F.col("item_id").alias("doc_id"), F.lit(0).alias("position"), X.content_tokens("text").alias("tokens"))
    return P.candidate_pairs(rows)


# --- summaries ---------------------------------------------------------------------------


def _count(cond: str, name: str) -> str:
    return f"count(*) FILTER ({cond}) AS {name}"


_VERDICTS = ", ".join(_count(f"verdict = '{v}'", f"n_{v}") for v in S.VERDICTS)
_CLASSES = ", ".join(_count(f"failure_class = '{c}'", f"n_{c}") for c in S.FAILURE_CLASSES)
_SUMMARY = f"""SELECT run_id, count(*) AS total_cases, {_VERDICTS}, round(count(*) FILTER (hit) / count(*), 4) AS retrieval_hit_rate, round(count(*) FILTER (is_correct) / count(*), 4) AS answer_correctness_rate,
  round(count(*) FILTER (verdict = 'lucky_pass') / count(*), 4) AS lucky_pass_rate, round(avg(groundedness), 4) AS mean_groundedness,
  CASE WHEN count(*) FILTER (verdict = 'lucky_pass') > 0 THEN count(*) FILTER (verdict = 'lucky_pass' AND confirmed) END AS ablation_confirmed_count, count(*) FILTER (judge_failed) AS judge_failure_count FROM cases GROUP BY run_id"""


@query(f"WITH {CASES} {_SUMMARY}")
def run_summary(t):
    return S.run_summary(t.cases, ["run_id"])


@query(f"""WITH {CASES} SELECT run_id, count(*) AS n_questions, round(count(*) FILTER (failure_class = 'pass') * 100.0 / count(*), 2) AS score, round(count(*) FILTER (is_correct) / count(*), 4) AS answer_accuracy,
  round(sum(recall) / count(*), 4) AS recall_at_k, round(sum(reciprocal_rank) / count(*), 4) AS mrr, {_CLASSES}, {_VERDICTS}, count(*) FILTER (judge_failed) AS judge_failures, count(adapter_error) AS adapter_errors,
  CASE WHEN count(*) FILTER (verdict = 'lucky_pass' AND confirmed IS NOT NULL) > 0 THEN count(*) FILTER (verdict = 'lucky_pass' AND confirmed) END AS lucky_pass_confirmed FROM cases GROUP BY run_id""")
def eval_summary(t):
    return S.eval_summary(t.cases, ["run_id"])


@query(f"WITH {CASES} SELECT doc_id, verdict, failure_class FROM cases")
def verdict_and_class(t):
    return t.cases.select("doc_id", "verdict", "failure_class")


@query(f"WITH q AS (SELECT {Q.split('CAST(doc_id AS VARCHAR)')} AS split, CASE WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'active' END AS status FROM documents), g AS (SELECT * FROM (SELECT unnest(['dev', 'test', 'none']) AS split), (SELECT unnest(['active', 'stale', 'rejected']) AS status)) SELECT split, status, count(q.status) AS n FROM g LEFT JOIN q USING (split, status) GROUP BY split, status")
def question_counts(t):
    q = t.documents.select(I.split_of(F.col("doc_id").cast("string")).alias("split"), F.when(F.col("doc_id") % 3 == 0, "stale").otherwise("active").alias("status"))
    return S.question_counts(q)


@query("WITH v AS (SELECT greatest(ceil(round(v * 10, 9)) - 1, 0)::BIGINT AS bin FROM (SELECT (doc_id * 37 % 101) / 100.0 AS v FROM documents)) SELECT b AS bin, count(v.bin) AS n, (b + 1) / 10 <= 0.5 AS kept FROM (SELECT unnest(range(0, 10)) AS b) LEFT JOIN v ON v.bin = b GROUP BY b")
def overlap_histogram(t):
    return S.overlap_histogram(t.documents.select((F.col("doc_id") * 37 % 101 / 100.0).alias("v")), "v")


@query("SELECT list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median FROM documents")
def overlap_median(t):
    return S.upper_median(t.documents, "n_chars")


@query("SELECT event_type AS reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type")
def reject_reason_rank(t):
    return E.reason_rank(t.events, "event_type")


_DOMINANT = "CASE greatest(n_retrieval_failure, n_lucky_pass, n_generation_failure) WHEN 0 THEN NULL WHEN n_retrieval_failure THEN 'retrieval_failure' WHEN n_lucky_pass THEN 'lucky_pass' ELSE 'generation_failure' END"


@query(f"WITH {CASES}, s AS ({_SUMMARY}) SELECT run_id, {_DOMINANT} AS dominant, CASE WHEN n_lucky_pass > 0 THEN 'lucky_pass' WHEN n_retrieval_failure >= n_generation_failure AND n_retrieval_failure > 0 THEN 'retrieval_failure' WHEN n_generation_failure > 0 THEN 'generation_failure' ELSE 'all_true_pass' END AS headline_kind FROM s")
def dominant_and_headline(t):
    return S.headline(S.dominant_failure(S.run_summary(t.cases, ["run_id"]))).select("run_id", "dominant", "headline_kind")


@query(f"""WITH {CASES}, s AS ({_SUMMARY} UNION ALL SELECT 9, 0, 0, 0, 0, 0, 0, 0, 0, NULL, NULL, 0),
v AS (SELECT *, run_id = 1 AS healthy, run_id = 2 AS blind FROM s) SELECT run_id,
  CASE WHEN total_cases = 0 THEN 'empty' WHEN healthy THEN 'healthy' ELSE 'needs_work' END AS status,
  CASE WHEN total_cases = 0 OR healthy THEN NULL WHEN blind THEN 'not_grounded' ELSE {_DOMINANT} END AS problem,
  CASE WHEN total_cases = 0 THEN 'write_questions' WHEN run_id = 3 THEN 'match_by_text' WHEN blind THEN 'return_contexts' WHEN healthy THEN 'keep_checking' ELSE 'fix_' || {_DOMINANT} END AS advice FROM v""")
def plain_summary(t):
    """Run 1 is made healthy, run 2 matches by text without any context, run 3 has no hit by id, and run 9 has no cases."""
    rows = S.run_summary(t.cases, ["run_id"])
    none = t.spark.createDataFrame([(9,)], "run_id bigint").select(*(F.col(c) if c == "run_id" else F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    rows = rows.unionByName(none)
    good = F.col("run_id") == 1
    rows = rows.withColumns({f"n_{v}": F.when(good, F.col("total_cases") if v == "true_pass" else F.lit(0)).otherwise(F.col(f"n_{v}")) for v in S.VERDICTS})
    hits = F.when(F.col("run_id") == 3, 0).otherwise(F.col("n_true_pass") + F.col("n_generation_failure"))
    text = F.col("run_id") == 2
    rows = rows.withColumns({"hits": hits, "match_by": F.when(text, "text").otherwise("id"), "any_context": ~text})
    return S.plain_summary(rows).select("run_id", "status", "problem", "advice")


@query("SELECT doc_id, CASE WHEN doc_id % 100 >= 80 THEN 'STRONG' WHEN doc_id % 100 >= 60 THEN 'GOOD' ELSE 'NEEDS WORK' END AS badge FROM documents")
def badge(t):
    return t.documents.select("doc_id", S.badge(F.col("doc_id") % 100).alias("badge"))


@query(f"WITH {CASES} SELECT run_id, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (failure_class = '{c}') / count(*), 4) AS share_{c}" for c in S.FAILURE_CLASSES) + " FROM cases GROUP BY run_id")
def failure_stack(t):
    return S.failure_stack(t.cases, "run_id")


@query(f"""WITH {CASES}, x AS (SELECT c.*, d.text, CASE WHEN hit THEN doc_id % 2 + 1 END AS rank, CASE WHEN doc_id % 3 = 0 THEN 'because' END AS rationale FROM cases c JOIN documents d USING (doc_id))
SELECT doc_id, coalesce('#' || rank, '–') AS rank_text,
  CASE verdict WHEN 'true_pass' THEN 'True pass' WHEN 'lucky_pass' THEN 'Lucky pass' WHEN 'generation_failure' THEN 'Generation failure' ELSE 'Retrieval failure' END AS label,
  CASE WHEN adapter_error IS NOT NULL THEN 'The pipeline raised an error, which counts as a failure: ' || adapter_error ELSE
    CASE verdict WHEN 'generation_failure' THEN 'The right passage came back at place ' || rank || ', and the answer was still wrong: look at the prompt or the model.'
      WHEN 'retrieval_failure' THEN 'The passage with the answer did not come back, and the answer was wrong.'
      WHEN 'lucky_pass' THEN 'The answer was right, though the passage that holds it did not come back.' || CASE WHEN confirmed THEN ' Asked again without passages it was right once more: it came from memory.'
        WHEN NOT confirmed THEN ' Asked again without passages it was wrong: another passage may have helped.' ELSE '' END
      ELSE 'The right passage, and the right answer.' END || CASE WHEN rationale IS NOT NULL AND verdict <> 'true_pass' THEN ' Judge: ' || rationale ELSE '' END END AS why,
  CASE WHEN verdict = 'true_pass' THEN 0 ELSE 3 END AS n_tries,
  CASE rank WHEN 1 THEN 'a <b>the</b> &lt;b&gt;' WHEN 2 THEN {Q.highlight('text', chr(39) + 'the' + chr(39))} END AS source_html,
  CASE WHEN NOT hit THEN {Q.highlight('text', chr(39) + 'the' + chr(39))} END AS gold_html FROM x""")
def case_explain(t):
    rows = t.cases.join(t.documents.select("doc_id", "text"), "doc_id").withColumns(
        {
            "rank": F.when(F.col("hit"), F.col("doc_id") % 2 + 1), "contexts": F.array(F.lit("a the <b>"), F.col("text")), "expected": F.lit("the"), "gold_text": F.col("text"),
            "rationale": F.when(F.col("doc_id") % 3 == 0, "because"), "error": F.col("adapter_error"),
        }
    )
    found = F.filter("passages", lambda p: p["source"])
    return E.explain_cases(rows).select("doc_id", "rank_text", "label", "why", F.size("tries").alias("n_tries"), F.try_element_at(found, F.lit(1))["html"].alias("source_html"), "gold_html")


@query(f"""WITH {CASES}, c AS (SELECT run_id, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (is_correct) AS correct, count(*) FILTER (verdict = 'lucky_pass') AS lucky,
  round(count(*) FILTER (hit) * 100.0 / count(*), 1) AS hit_pct, round(count(*) FILTER (is_correct) * 100.0 / count(*), 1) AS correct_pct, round(count(*) FILTER (verdict = 'true_pass') * 100.0 / count(*), 1) AS ring,
  count(*) FILTER (verdict = 'true_pass') || '/' || count(*) AS ring_text, round(avg(groundedness) * 100, 1) AS grounded_pct, count(*) FILTER (judge_failed) AS judge_failures FROM cases GROUP BY run_id)
SELECT *, CASE WHEN hit_pct > correct_pct THEN 'More hits than right answers: what went wrong came after the search.' WHEN hit_pct < correct_pct THEN 'More right answers than hits: some did not come from the right page.' ELSE 'As many hits as right answers: where the page was found, the answer followed.' END
  || '|' || CASE WHEN lucky = 0 THEN 'No lucky passes: right answers came from the documents.' ELSE 'Lucky passes, which the search did not earn: ' || lucky END
  || CASE WHEN n < 20 THEN '|A small sample: ' || n WHEN judge_failures > 0 THEN '|Replies of the judge that could not be read: ' || judge_failures ELSE '' END AS bullets FROM c""")
def stat_cards(t):
    return E.bullets(E.stat_cards(t.cases, ["run_id"])).withColumn("bullets", F.array_join("bullets", "|"))


@query(f"WITH {CASES} SELECT DISTINCT question_id FROM cases WHERE hit AND run_id = 2")
def distinct_ids(t):
    return E.distinct_ids(t.cases.withColumns({"config_hash": F.concat(F.lit("c"), "run_id"), "split": F.when(F.col("hit"), "dev").otherwise("test")}), "c2", "dev")


@query("SELECT source, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS captured FROM (SELECT user_id % 20 AS source, ts FROM events) GROUP BY source")
def captured_date(t):
    return E.captured_date(t.events.withColumn("source", F.col("user_id") % 20), "source", "ts")


@query("SELECT q AS questions, 3 + 2 * q AS least_calls, 3 + 4 * q AS most_calls FROM (SELECT unnest(range(1, 21)) AS q)")
def cost_estimate(t):
    return t.spark.createDataFrame([(q, *P.check_cost(3, q)) for q in range(1, 21)], "questions bigint, least_calls bigint, most_calls bigint")


@query(f"SELECT count(*) AS n FROM documents WHERE {Q.split('CAST(doc_id AS VARCHAR)')} = 'test' AND doc_id % 3 <> 0")
def counts_only(t):
    rows = t.documents.select(I.split_of(F.col("doc_id").cast("string")).alias("split"), F.when(F.col("doc_id") % 3 == 0, "stale").otherwise("active").alias("status"))
    return E.count_of(rows)


# --- trials ------------------------------------------------------------------------------


@query(f"WITH {TRIALS} SELECT tune_id, trial_index, score, config FROM trials QUALIFY row_number() OVER (PARTITION BY tune_id ORDER BY score DESC, trial_index) = 1")
def best_trial(t):
    return H.best_trial(t.trials)


@query(f"WITH {TRIALS} SELECT *, max(score) OVER (PARTITION BY tune_id ORDER BY trial_index ROWS UNBOUNDED PRECEDING) AS best_so_far FROM trials")
def best_so_far(t):
    return H.best_so_far(t.trials)


@query("SELECT p_partkey, round(dev - test, 2) AS gap, round(dev - test, 2) > 10 AS overfit FROM (SELECT p_partkey, p_size * 1.5 AS dev, (p_partkey % 30) * 1.5 AS test FROM part)")
def overfit_gap(t):
    rows = t.part.select("p_partkey", (F.col("p_size") * F.lit(1.5)).alias("dev_score"), (F.col("p_partkey") % 30 * F.lit(1.5)).alias("test_score"))
    return H.overfit_gap(rows).select("p_partkey", "gap", "overfit")


@query("SELECT knob, o AS old, n AS new FROM (SELECT unnest(['k', 'w', 'mode']) AS knob, unnest(['5', '0.5', 'bm25']) AS o) FULL JOIN (SELECT unnest(['k', 'w', 'rerank']) AS knob, unnest(['8', '0.5', 'yes']) AS n) USING (knob) WHERE o IS DISTINCT FROM n")
def knob_changes(t):
    make = lambda m: t.spark.createDataFrame(list(m.items()), "knob string, value string")
    return H.knob_changes(make({"k": "5", "w": "0.5", "mode": "bm25"}), make({"k": "8", "w": "0.5", "rerank": "yes"}))


@query(f"WITH {TRIALS} SELECT config AS source, count(*) AS n FROM trials GROUP BY config")
def source_counts(t):
    return E.source_counts(t.trials, "config")


@query(f"WITH {TRIALS}, f AS (SELECT * FROM trials QUALIFY row_number() OVER (PARTITION BY tune_id ORDER BY trial_index DESC) <= 8) SELECT tune_id, trial_index, score, row_number() OVER (PARTITION BY tune_id ORDER BY trial_index) AS x FROM f")
def loop_view(t):
    return E.loop_view(t.trials).select("tune_id", "trial_index", "score", "x")


@query(f"WITH {TRIALS} SELECT tune_id, max(score) AS best, count(*) AS n_trials, max(CASE WHEN trial_index = 0 THEN score END) AS baseline FROM trials GROUP BY tune_id")
def tune_extra(t):
    return E.tune_extra(t.trials)


@query(f"""WITH {TRIALS}, b AS (SELECT tune_id, trial_index FROM trials QUALIFY row_number() OVER (PARTITION BY tune_id ORDER BY score DESC, trial_index) = 1),
f AS (SELECT o_orderpriority AS tune_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS trial_index, o_orderkey AS k FROM orders),
q AS (SELECT tune_id, trial_index, k * 10 + j AS question_id FROM f, (SELECT unnest(range(0, 8)) AS j))
SELECT tune_id, trial_index, question_id FROM q JOIN b USING (tune_id, trial_index) QUALIFY row_number() OVER (PARTITION BY tune_id ORDER BY question_id) <= 5""")
def feedback_topk(t):
    place = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    rows = t.orders.select(F.col("o_orderpriority").alias("tune_id"), (F.row_number().over(place) - 1).alias("trial_index"), "o_orderkey")
    failed = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("tune_id", "trial_index", (F.col("o_orderkey") * 10 + F.col("j")).alias("question_id"))
    return E.feedback(t.trials, failed).select("tune_id", "trial_index", "question_id")


# --- ordering and history ----------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_by(t):
    return N.latest_by(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(f"WITH {CASES}, {RUNS} SELECT run_id, kind, coalesce(lag(run_id) OVER (PARTITION BY kind ORDER BY created_at, run_id), -1) AS prev_run_id FROM runs")
def previous_run_same_kind(t):
    return H.previous_runs(t.runs).select("run_id", "kind", F.coalesce("prev_run_id", F.lit(-1)).alias("prev_run_id"))


_PTS = "round(count(*) FILTER (c.{0}) * 100.0 / count(*), 1) - round(count(*) FILTER (p.{0}) * 100.0 / count(*), 1)"


@query(f"""WITH {CASES}, {RUNS}, l AS (SELECT *, lag(run_id) OVER w AS prev, lag(fingerprint) OVER w AS pf FROM runs WINDOW w AS (PARTITION BY kind ORDER BY created_at, run_id)),
o AS (SELECT run_id, question_id, verdict = 'true_pass' AS tp, verdict IN ('true_pass', 'generation_failure') AS h, verdict = 'lucky_pass' AS lucky FROM cases),
own AS (SELECT run_id, count(*) AS n, round(count(*) FILTER (tp) * 100.0 / count(*), 1) AS tpp, round(count(*) FILTER (h) * 100.0 / count(*), 1) AS hp, count(*) FILTER (lucky) AS lp FROM o GROUP BY run_id),
d AS (SELECT l.run_id, count(*) AS shared, round({_PTS.format('tp')}, 1) AS dt, round({_PTS.format('h')}, 1) AS dh FROM l JOIN o c ON c.run_id = l.run_id JOIN o p ON p.run_id = l.prev AND p.question_id = c.question_id GROUP BY l.run_id)
SELECT l.run_id, kind, coalesce(prev, -1) AS prev_run_id, n AS n_questions, tpp AS true_pass_pct, hp AS retrieval_hit_pct, lp AS lucky_pass_count, coalesce(shared, 0) AS shared_questions, dt AS delta_true_pass, dh AS delta_retrieval_hit,
  prev IS NOT NULL AND coalesce(shared, 0) < 10 AS small_sample, coalesce(fingerprint <> pf, FALSE) AS corpus_changed FROM l LEFT JOIN own USING (run_id) LEFT JOIN d USING (run_id)""")
def history_delta(t):
    return H.history_delta(t.runs, t.cases.select("run_id", "question_id", "verdict")).withColumn("prev_run_id", F.coalesce("prev_run_id", F.lit(-1)))


@query("WITH r AS (SELECT user_id AS run_id, min(event_type) AS kind, min(ts) AS created_at FROM events GROUP BY user_id), n AS (SELECT *, row_number() OVER (ORDER BY created_at, run_id) AS number, row_number() OVER (PARTITION BY kind ORDER BY created_at, run_id) = 1 AS first_of_kind, count(*) OVER () AS total FROM r) SELECT run_id, kind, number, first_of_kind FROM n WHERE number > total - 30")
def run_number_chart(t):
    runs = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.min("event_type").alias("kind"), F.min("ts").alias("created_at"))
    return H.chart_rows(runs).select("run_id", "kind", "number", "first_of_kind")


@query("SELECT doc_id FROM documents ORDER BY sha256('3:v1:' || doc_id), CAST(doc_id AS VARCHAR) LIMIT 50")
def regression_sample(t):
    return P.regression_sample(t.documents.select("doc_id", F.col("doc_id").cast("string").alias("question_id")), 50, 3, "v1").select("doc_id")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 3")
def examples_per_reason(t):
    return E.first_of_each(t.events, "event_type", ["ts", "event_id"]).select("event_type", "event_id")


@query("SELECT sha256(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_pool(t):
    return N.first_of_key(t.documents.select(F.sha2("text", 256).alias("key"), "doc_id"), "key", ["doc_id"])


@query("SELECT c_custkey, o_orderkey, rank FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_retrieval(t):
    return V.top_k(t.orders, 3, query="o_custkey", score="o_totalprice", tie="o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "rank")


# --- sets, plans, budgets ----------------------------------------------------------------


@query(f"WITH {POOL} SELECT chunk_id FROM pool UNION SELECT CAST(doc_id AS VARCHAR) FROM labels")
def union_done_keys(t):
    return E.union_done_keys(t.pool, t.labels.select(F.col("doc_id").cast("string").alias("chunk_id")), key="chunk_id")


@query(f"WITH {VERSIONS} (SELECT 'new' AS side, chunk_id FROM (SELECT chunk_id FROM new EXCEPT SELECT chunk_id FROM old)) UNION ALL (SELECT 'deleted', chunk_id FROM (SELECT chunk_id FROM old EXCEPT SELECT chunk_id FROM new)) UNION ALL SELECT 'both', chunk_id FROM (SELECT chunk_id FROM new INTERSECT SELECT chunk_id FROM old)")
def set_except_intersect(t):
    return E.id_sets(*t.versions)


@query("WITH o AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY sha256('0:v2:' || doc_id), CAST(doc_id AS VARCHAR) LIMIT 50) SELECT doc_id, TRUE AS is_new FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, FALSE FROM o")
def select_questions(t):
    q = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("question_id"))
    return P.select_questions(q, t.labels.select(F.col("doc_id").cast("string").alias("question_id")), "v1", "v2")[1].select("doc_id", "is_new")


@query(f"WITH {POOL} SELECT question_key, CASE WHEN n.hash IS NULL THEN 'deleted' WHEN n.hash = chunk_hash THEN 'reuse' ELSE 'changed' END AS action FROM pool LEFT JOIN new n USING (chunk_id)")
def plan_questions(t):
    old, new = t.versions
    return P.plan_pool(t.pool, old, new).select("question_key", "action")


@query(f"""WITH {POOL}, ch AS (SELECT chunk_id, count(*) AS n_questions FROM pool JOIN new n USING (chunk_id) WHERE n.hash <> chunk_hash GROUP BY chunk_id),
nw AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS i, count(*) OVER () AS n FROM new WHERE chunk_id NOT IN (SELECT chunk_id FROM old)), q AS (SELECT greatest(1, round(100.0 * (SELECT count(*) FROM nw) / (SELECT count(*) FROM new)))::BIGINT AS q)
SELECT * FROM ch UNION ALL SELECT DISTINCT chunk_id, CAST(1 AS BIGINT) FROM nw, q JOIN (SELECT unnest(range(0, 100)) AS j) ON j < q WHERE i = (j * n) // q""")
def chunks_to_write(t):
    return P.chunks_to_write(t.pool, *t.versions, 100)


@query(f"WITH {POOL} SELECT n.chunk_id, CASE WHEN p.chunk_id IS NOT NULL AND o.hash <> n.hash THEN 0 WHEN o.hash IS NULL THEN 1 WHEN p.chunk_id IS NULL THEN 2 ELSE 3 END::BIGINT AS priority FROM new n LEFT JOIN old o USING (chunk_id) LEFT JOIN pool p ON p.chunk_id = n.chunk_id")
def plan_generation(t):
    old, new = t.versions
    return P.plan_generation(new, t.pool, old)


@query("SELECT doc_id, spent FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM documents) WHERE spent <= 50000")
def budget(t):
    return P.within_budget(t.documents.select("doc_id", "n_chars"), 50_000, ["doc_id"], "n_chars").select("doc_id", "spent")


@query("SELECT CAST(row_number() OVER (ORDER BY m, k) - 1 AS BIGINT) AS config_index, m AS mode, CAST(k AS VARCHAR) AS k FROM (SELECT unnest(['a', 'b']) AS m), (SELECT unnest(range(1, 6)) AS k)")
def grid(t):
    return P.grid(t.spark, {"mode": ["a", "b"], "k": {"min": 1, "max": 5, "step": 1}})


@query("SELECT m AS mode, CAST(k AS VARCHAR) AS k, row_number() OVER (ORDER BY sha256('9|' || m || '|' || k)) - 1 AS trial_order FROM (SELECT unnest(['a', 'b']) AS m), (SELECT unnest(range(1, 6)) AS k)")
def random_order(t):
    return P.random_order(P.grid(t.spark, {"mode": ["a", "b"], "k": [1, 2, 3, 4, 5]}), 9).select("mode", "k", "trial_order")


@query(f"WITH {CASES}, k AS (SELECT unnest(range(1, 5)) AS k) SELECT k, count(*) AS n, round(count(*) FILTER (is_correct AND doc_id % 4 < k) * 100.0 / count(*), 2) AS score FROM cases, k GROUP BY k")
def tune_grid(t):
    configs = F.broadcast(P.grid(t.spark, {"k": [1, 2, 3, 4]}).select(F.col("k").cast("bigint").alias("k")))
    rows = t.cases.crossJoin(configs).withColumn("ok", F.col("is_correct") & (F.col("doc_id") % 4 < F.col("k")))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if("ok") * 100.0 / F.count(F.lit(1)), 2).alias("score"))


# --- judges and boundary -----------------------------------------------------------------


@query(f"WITH {Q.CLOZE} SELECT query_id, len([w FOR w IN {Q.content('expected')} IF NOT list_contains({Q.content('gold')}, w)]) = 0 AS right_source, len([w FOR w IN {Q.content('expected')} IF NOT list_contains({Q.content('text')}, w)]) = 0 AS right_question FROM questions")
def det_judge_correctness(t):
    return t.questions.select("query_id", S.judge_correct("expected", "gold").alias("right_source"), S.judge_correct("expected", "text").alias("right_question"))


@query(f"WITH {Q.CLOZE}, s AS (SELECT query_id, {Q.content('gold')} AS a, {Q.content('text')} AS c FROM questions) SELECT query_id, CASE WHEN len(a) > 0 THEN round({Q.shared('a', 'c')}::DOUBLE / len(a), 3) END AS score FROM s")
def det_judge_groundedness(t):
    return t.questions.select("query_id", S.judge_grounded("gold", F.array("text")).alias("score"))


@query(f"""WITH s AS (SELECT item_id, {Q.content('text')} AS q, {Q.sentences('text')} AS ss FROM benchmark), u AS (SELECT item_id, q, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS place, ss[1] AS lead FROM s),
c AS (SELECT *, {Q.shared('q', Q.content('sentence'))} AS shared FROM u) SELECT item_id, first(sentence ORDER BY shared DESC, place) AS answer, any_value(lead) AS lead FROM c GROUP BY item_id""")
def det_answer(t):
    context = F.array(F.col("text"))
    return t.benchmark.select("item_id", X.best_sentence(context, "text").alias("answer"), X.lead_sentence(context).alias("lead"))


def _echo_adapter():
    def ask(question: str) -> dict:
        if question.startswith("a"):
            raise ValueError("no answer")
        return {"answer": question.upper(), "retrieved_chunk_ids": ["c1"], "contexts": [question]}

    return ask


@query("WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark), q AS (SELECT item_id AS query_id, array_to_string(t[1:len(t) - 6], ' ') AS q FROM t WHERE len(t) > 6) SELECT query_id, CASE WHEN starts_with(q, 'a') THEN '' ELSE upper(q) END AS answer, CASE WHEN starts_with(q, 'a') THEN 'no answer' END AS error FROM q")
def udf_adapter(t):
    from .operators.boundary import run_adapter

    return run_adapter(t.questions, _echo_adapter, "query_id", "text").select("query_id", "answer", "error")


class _EchoClient:
    def complete(self, system: str, user: str) -> str:
        return user


@query(f"WITH {CASES}, b AS (SELECT doc_id, verdict, 'w' || doc_id AS e FROM cases) SELECT doc_id, CASE WHEN verdict = 'lucky_pass' THEN doc_id % 2 = 0 END AS confirmed FROM b")
def ablate(t):
    from .operators.boundary import ablate as run

    word = F.concat(F.lit("w"), F.col("doc_id"))
    rows = t.cases.drop("confirmed").withColumns({"question": F.when(F.col("doc_id") % 2 == 0, word).otherwise("other"), "expected": word})
    return run(rows, _EchoClient, "doc_id").select("doc_id", "confirmed")


@query(f"WITH {CASES}, s AS (SELECT *, {Q.split('CAST(doc_id AS VARCHAR)')} AS split FROM cases) SELECT count(*) AS n_questions, round(count(*) FILTER (failure_class = 'pass') * 100.0 / count(*), 2) AS score FROM s WHERE split = 'test'")
def locked_eval(t):
    return K.exam_summary(t.cases.withColumn("split", I.split_of(F.col("doc_id").cast("string")))).select("n_questions", "score")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_rates(t):
    return event_rates(t.events)


# --- generation --------------------------------------------------------------------------


def _sources(t):
    from .plans.generate import single_sources

    return single_sources(t.chunks)


@query()
def det_facts(t):
    from .plans import offline

    return offline.facts(_sources(t)).select("source_key", "fact", "answer")


@query()
def det_question_rewrite(t):
    from .plans import offline

    return offline.reword(offline.draft(offline.facts(_sources(t)))).select("source_key", "draft", "question")


@query()
def generate_questions(t):
    from .plans import offline

    return offline.questions(_sources(t))


@query()
def generate_multihop(t):
    from .plans import offline
    from .plans.generate import pair_sources

    chunks = t.chunks
    return offline.questions(pair_sources(P.candidate_pairs(chunks.withColumn("tokens", X.content_tokens("text"))), chunks, 200))


@query(f"WITH {Q.CLOZE}, v AS (SELECT query_id, {Q.content('gold')} AS f, {Q.content('text')} AS q, {Q.content('expected')} AS e FROM questions) SELECT query_id, len([w FOR w IN list_intersect(q, f) IF NOT list_contains(e, w)]) >= 2 AS unambiguous FROM v")
def det_verify(t):
    from .plans.generate import verify_by_rule

    rows = t.questions.select("query_id", F.col("gold").alias("fact"), F.col("text").alias("question"), F.col("expected").alias("answer"), F.col("gold").alias("text"))
    return verify_by_rule(rows).select("query_id", "unambiguous")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents")
def scan_store_ordered(t):
    return E.ordered(t.documents.select("doc_id", "lang"), ["lang"], ["doc_id"])


@query(f"WITH {CASES} SELECT c.doc_id, c.verdict, l.quality FROM cases c JOIN labels l ON l.doc_id = c.question_id")
def join_results_to_questions(t):
    return E.results_of_questions(t.cases.select("doc_id", "verdict", "question_id"), t.labels.select(F.col("doc_id").alias("question_id"), "quality")).drop("question_id")

