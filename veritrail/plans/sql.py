"""Fragments of DuckDB SQL that the oracles of several queries share."""

from __future__ import annotations

from ..functions.ids import SPLIT_SALT
from ..functions.text import STOPWORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def numeric(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:[.,][0-9]+)*')"


def fold(x: str) -> str:
    return f"[CASE WHEN length(t) > 3 AND right(t, 1) = 's' AND right(t, 2) <> 'ss' THEN left(t, length(t) - 1) ELSE t END FOR t IN {x}]"


def content(x: str) -> str:
    return f"list_distinct({fold(f'[w FOR w IN {numeric(x)} IF NOT list_contains({STOP}, w)]')})"


def bigrams(x: str) -> str:
    return f"list_distinct([u[1] || ' ' || u[2] FOR u IN list_zip({tokens(x)}, {tokens(x)}[2:]) IF u[2] IS NOT NULL])"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def match(a: str, b: str) -> str:
    """Of two lists of bigrams."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {shared(a, b)}::DOUBLE / greatest(least(len({a}), len({b})), 8) END"


def hashed(key: str, salt: str) -> str:
    return f"(('0x' || substr(sha256('{salt}:' || {key}), 1, 8))::BIGINT)"


def split(chunk: str) -> str:
    return f"CASE WHEN {hashed(chunk, SPLIT_SALT)} % 100 < 70 THEN 'dev' ELSE 'test' END"


SPACES = r"[ \t\n\x0B\f\r]+"


def folded(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'), ' ')"


def excerpt(x: str, answer: str, width: int = 700) -> str:
    """Of a text and a literal answer that is not empty."""
    t = folded(x)
    start = f"CASE WHEN instr(lower({t}), lower({answer})) = 0 THEN 0 ELSE greatest(0, instr(lower({t}), lower({answer})) - 1 - {width // 3}) END"
    cut = f"CASE WHEN {start} > 0 THEN '…' ELSE '' END || substr({t}, {start} + 1, {width}) || CASE WHEN {start} + {width} < length({t}) THEN '…' ELSE '' END"
    return f"CASE WHEN length({t}) <= {width} THEN {t} ELSE {cut} END"


def escaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"


def highlight(x: str, answer: str) -> str:
    return f"regexp_replace({escaped(excerpt(x, answer))}, regexp_escape({answer}), '<b>\\0</b>', 'gi')"


def sentences(x: str) -> str:
    lines = f"[l FOR l IN [trim(y, ' ') FOR y IN string_split({x}, chr(10))] IF l <> '' AND NOT starts_with(l, '#')]"
    marked = f"regexp_replace(array_to_string({lines}, ' '), '([.!?]){SPACES}([A-Z0-9\"''(])', '\\1' || chr(1) || '\\2', 'g')"
    return f"[s FOR s IN string_split({marked}, chr(1)) IF s <> '']"


def tree_hash(table: str, value: str, by: str, name: str, distinct: bool = True) -> str:
    """One hash of all values of each group, by the first four digits of their own hashes."""
    rows = f"SELECT {'DISTINCT ' if distinct else ''}{by}, {value} AS v FROM {table}"
    groups = f"SELECT {by}, left(sha256(v), 4) AS p, sha256(string_agg(v, chr(10) ORDER BY v)) AS h FROM ({rows}) GROUP BY ALL"
    return f"SELECT {by}, sha256(string_agg(h, chr(10) ORDER BY p)) AS {name} FROM ({groups}) GROUP BY {by}"


CHUNKS = """chunks AS (
  SELECT doc_id || '#' || pos AS chunk_id, doc_id, pos AS position, substr(text, pos * 700 + 1, 800) AS text, sha256(substr(text, pos * 700 + 1, 800)) AS hash
  FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 700.0) AS BIGINT))) AS pos FROM documents WHERE length(text) > 0))"""

CLOZE = f"""items AS (SELECT item_id AS query_id, text AS gold, {tokens('text')} AS t FROM benchmark),
questions AS (SELECT query_id, gold, array_to_string(t[1:len(t) - 6], ' ') AS text, array_to_string(t[len(t) - 5:], ' ') AS expected FROM items WHERE len(t) > 6)"""

BM25 = f"""tok AS (SELECT chunk_id, {tokens('text')} AS ts FROM chunks),
stat AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tok),
post AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM questions) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT query_id, chunk_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
  FROM post JOIN asked USING (term) JOIN freq USING (term), stat GROUP BY query_id, chunk_id)"""


def top(scored: str, k: int) -> str:
    return f"SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {scored} QUALIFY rank <= {k}"


DEGRADED = f"""ranked AS ({top('scored', 5)}),
numbered AS (SELECT chunk_id, row_number() OVER (ORDER BY doc_id, position) - 1 AS number FROM chunks),
picked AS (SELECT query_id, rank, chunk_id, {hashed('query_id', 'degraded')} % 100 < 30 AS swap,
  ('0x' || substr(sha256('degraded:' || query_id || ':' || rank), 1, 8))::BIGINT % (SELECT count(*) FROM chunks) AS pick FROM ranked),
degraded AS (SELECT query_id, rank, CASE WHEN swap THEN n.chunk_id ELSE p.chunk_id END AS chunk_id, swap FROM picked p JOIN numbered n ON p.pick = n.number)"""

AUDIT = f"""{CHUNKS}, {CLOZE}, {BM25}, {DEGRADED},
ctx AS (SELECT d.query_id, rank, chunk_id, c.text, {match('g', 'h')} AS score FROM (
  SELECT d.*, {bigrams('q.gold')} AS g, {bigrams('c.text')} AS h FROM degraded d JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id)) d JOIN chunks c USING (chunk_id)),
found AS (SELECT query_id, min(CASE WHEN score >= 0.5 THEN rank END) AS match_rank, round(max(score), 4) AS match_score FROM ctx GROUP BY query_id),
answered AS (SELECT q.query_id, b.chunk_id AS best_chunk, match_rank, coalesce(match_score, 0.0) AS match_score, match_rank IS NOT NULL AS hit, q.expected,
  CASE WHEN {hashed('q.query_id', 'memory')} % 100 < 25 THEN q.expected ELSE coalesce(b.text, '') END AS answer
  FROM questions q LEFT JOIN found USING (query_id) LEFT JOIN (SELECT * FROM ctx WHERE rank = 1) b ON b.query_id = q.query_id),
judged AS (SELECT *, len([w FOR w IN {content('expected')} IF NOT list_contains({content('answer')}, w)]) = 0 AS is_correct FROM answered),
cases AS (SELECT query_id, best_chunk, match_rank, match_score, hit, is_correct,
  CASE WHEN hit AND is_correct THEN 'true_pass' WHEN is_correct THEN 'lucky_pass' WHEN hit THEN 'generation_failure' ELSE 'retrieval_failure' END AS verdict,
  CASE WHEN NOT hit THEN 'retrieval_miss' WHEN is_correct THEN 'pass' ELSE 'generation_miss' END AS failure_class FROM judged)"""
