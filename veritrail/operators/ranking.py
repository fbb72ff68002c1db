"""Best passages for a bounded set of questions, in one pass over the corpus.

The questions are small enough to be sent to every task, which scores its own passages for all of
them in batches and keeps the best of each question. So what is shuffled is a few rows a
question and task, never a row for each question and passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, column

K1, B = 1.5, 0.75
#: Scores are rounded before they are compared, so that equal passages tie in any order of summation.
DIGITS = 6
#: Questions, and bytes of their text, that are sent to every task at most.
MOST_QUERIES, MOST_BYTES = 2048, 1 << 22
#: Scores that are held at a time.
CELLS = 1 << 21
_LETTERS = 37
_SHORT = _LETTERS**3


def padded(text: Column | str) -> Column:
    """The tokens with a space before, between and after them: one replacement instead of an array that is joined again."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(column(text)), "[^a-z0-9]+", " ")), F.lit(" "))


def bounded(queries: DataFrame, text: str = "text") -> bool:
    """Whether the questions may be sent to every task."""
    row = queries.limit(MOST_QUERIES + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size")).head()
    return row["n"] <= MOST_QUERIES and row["size"] <= MOST_BYTES


def batch_rows(queries: int) -> int:
    return max(16, min(1024, CELLS // max(1, queries)))


def _words(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place in the vocabulary of its words, and the number of all words of each row, of padded texts."""
    lists = pc.split_pattern(texts, " ")
    row, flat = np.asarray(pc.list_parent_indices(lists)), pc.list_flatten(lists)
    real = np.asarray(pc.not_equal(flat, ""))
    known = pc.index_in(flat, value_set=vocabulary)
    lengths = np.bincount(row[real], minlength=len(texts))
    have = np.asarray(known.is_valid())
    return row[have], np.asarray(known.drop_null()).astype(np.int64), lengths


class Sparse:
    """Weights of questions by term, for products with the terms of passages."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, queries: int):
        order = np.argsort(term, kind="stable")
        self.query, self.weight, self.queries = query[order], weight[order].astype(float), queries
        self.start = np.searchsorted(term[order], np.arange(terms + 1))

    def product(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """``[question, row]``: sums of weight times value over common terms."""
        count = self.start[term + 1] - self.start[term]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[term] - (ends - count), count)
        place = self.query[at] * rows + np.repeat(row, count)
        return np.bincount(place, self.weight[at] * np.repeat(value, count), self.queries * rows).reshape(self.queries, rows)


class Lexical:
    """BM25 of the questions; ``parts`` and ``mean`` are known after a pass over the corpus."""

    def __init__(self, texts: list[str]):
        words = [t.split() for t in texts]
        names = sorted({w for ws in words for w in ws})
        number = {w: i for i, w in enumerate(names)}
        self.vocabulary, self.queries = pa.array(names, pa.string()), len(texts)
        pairs = [(q, number[w]) for q, ws in enumerate(words) for w in ws]
        found, times = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0, return_counts=True)
        self.asked = (found[:, 0], found[:, 1], times)
        self.mean, self.weights = 1.0, None

    def learn(self, docs: int, total: int, frequency: np.ndarray) -> None:
        query, term, times = self.asked
        inverse = np.log((docs - frequency + 0.5) / (frequency + 0.5) + 1.0)
        self.mean = total / docs if docs and total else 1.0
        self.weights = Sparse(query, term, times * inverse[term], len(self.vocabulary), self.queries)

    def score(self, texts: pa.Array) -> np.ndarray:
        row, term, lengths = _words(texts, self.vocabulary)
        pair, tf = np.unique(row * max(1, len(self.vocabulary)) + term, return_counts=True)
        row, term = np.divmod(pair, max(1, len(self.vocabulary)))
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / self.mean))
        return np.round(self.weights.product(row, term, part, len(texts)), DIGITS)


def _letters() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[48:58] = np.arange(1, 11)
    out[97:123] = np.arange(11, 37)
    return out


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and count of the distinct trigrams of padded texts; a text without words is one short gram."""
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    data = _letters()[np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)]
    if len(data) < 3:
        code, row = np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = owner[2:] == owner[:-2]
        code = ((data[:-2] * _LETTERS + data[1:-1]) * _LETTERS + data[2:])[inside]
        row = owner[2:][inside]
    short = np.flatnonzero(sizes < 3)
    pair, count = np.unique(np.concatenate([row, short]) * (_SHORT + 1) + np.concatenate([code, np.full(len(short), _SHORT)]), return_counts=True)
    return pair // (_SHORT + 1), pair % (_SHORT + 1), count


class Trigram:
    """Cosine of trigram counts."""

    def __init__(self, texts: list[str]):
        row, code, count = trigrams(pa.array(texts, pa.string()))
        names, place = np.unique(code, return_inverse=True)
        self.place = np.full(_SHORT + 1, -1, np.int64)
        self.place[names] = np.arange(len(names))
        self.counts = np.zeros((len(texts), len(names)), np.float32)
        self.counts[row, place] = count
        self.norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, len(texts)))

    def score(self, texts: pa.Array) -> np.ndarray:
        row, code, count = trigrams(texts)
        norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, len(texts)))
        known = self.place[code] >= 0
        own = np.zeros((self.counts.shape[1], len(texts)), np.float32)
        own[self.place[code[known]], row[known]] = count[known]
        # Sums of products of counts are whole numbers, and exact.
        return np.round((self.counts @ own) / (self.norm[:, None] * norm), DIGITS)


class Overlap:
    """Shared words, each counted once; passages that share none are ranked too."""

    def __init__(self, texts: list[str], ignored: tuple[str, ...]):
        words = [sorted(set(t.split()) - set(ignored)) for t in texts]
        names = sorted({w for ws in words for w in ws})
        number = {w: i for i, w in enumerate(names)}
        self.vocabulary = pa.array(names, pa.string())
        pairs = np.array([(q, number[w]) for q, ws in enumerate(words) for w in ws], np.int64).reshape(-1, 2)
        self.weights = Sparse(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)), len(names), len(texts))

    def score(self, texts: pa.Array) -> np.ndarray:
        row, term, _ = _words(texts, self.vocabulary)
        pair = np.unique(row * max(1, len(self.vocabulary)) + term)
        row, term = np.divmod(pair, max(1, len(self.vocabulary)))
        return self.weights.product(row, term, np.ones(len(row)), len(texts))


class Hybrid:
    """(1 - weight) x BM25 by the question's best + weight x trigram cosine."""

    def __init__(self, lexical: Lexical, vector: Trigram, most: np.ndarray, weight: float):
        self.lexical, self.vector, self.most, self.weight = lexical, vector, most, weight

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.round((1 - self.weight) * self.lexical.score(texts) / self.most + self.weight * self.vector.score(texts), DIGITS)


class Best:
    """The k best passages of each question so far: by score, then the smaller id."""

    def __init__(self, queries: int, k: int, least: float):
        self.k, self.least = k, least
        self.found: list[list[tuple[float, object]]] = [[] for _ in range(queries)]
        self.floor = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, ids: list) -> None:
        for q in np.flatnonzero((scores.max(1) >= self.floor) & (scores.max(1) > self.least)).tolist():
            own = scores[q]
            enough = max(self.floor[q], np.partition(own, len(own) - self.k)[len(own) - self.k]) if len(own) > self.k else self.floor[q]
            places = np.flatnonzero((own >= enough) & (own > self.least)).tolist()
            best = sorted([*self.found[q], *((-own[i], ids[i]) for i in places)])[: self.k]
            self.found[q] = best
            if len(best) == self.k:
                self.floor[q] = -best[-1][0]


def _scan(rows: DataFrame, ids: pa.Array, score: Callable[[pa.Array], np.ndarray], k: int, least: float, query_type: str) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of ``chunk_id, padded`` rows: the k best of each question that score above ``least``."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, score))
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, score = shared.value
        best, step, type_of = Best(len(names), k, least), batch_rows(len(names)), pa.string()
        for batch in batches:
            type_of = batch.column(0).type
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                best.add(score(part.column(1)), part.column(0).to_pylist())
        out = [(q, c, -s) for q, found in enumerate(best.found) for s, c in found]
        if out:
            q, c, s = zip(*out)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(c, type_of), pa.array(s, pa.float64())], ["query_id", "chunk_id", "score"])

    found = rows.mapInArrow(run, f"query_id {query_type}, chunk_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def _learn(rows: DataFrame, lexical: Lexical) -> None:
    """Documents, words and the frequency of the questions' words, from one pass that adds up a few rows a task."""
    shared = rows.sparkSession.sparkContext.broadcast(lexical.vocabulary)
    terms = len(lexical.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total, frequency = 0, 0, np.zeros(terms, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                row, term, lengths = _words(batch.column(0).slice(at, 1024), shared.value)
                docs, total = docs + len(lengths), total + int(lengths.sum())
                frequency += np.bincount(np.unique(row * max(1, terms) + term) % max(1, terms), minlength=terms)[:terms]
        some = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([docs, total, *frequency[some].tolist()], pa.int64())], ["term", "n"])

    counts = {r["term"]: r["n"] for r in rows.select("padded").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    lexical.learn(counts.get(-2, 0), counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(terms)], float))


def best_passages(chunks: DataFrame, queries: DataFrame, k: int, ranker: str, weight: float = 0.5, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the k best passages, ties to the smaller chunk_id.

    ``ranker``: ``bm25``, ``trigram``, ``hybrid`` of both (``weight`` is the trigrams') or ``overlap``
    of words that are not ``ignored``. Passages that have nothing of a question are left out, but
    for ``overlap``, which always gives k. ``queries`` must be :func:`bounded`.
    """
    rows = chunks.select("chunk_id", padded("text").alias("padded")).where(F.col("padded").isNotNull())
    asked = queries.select("query_id", padded("text").alias("padded")).where(F.col("padded").isNotNull()).toArrow()
    ids, texts = asked["query_id"].combine_chunks(), asked["padded"].to_pylist()
    kind = queries.schema["query_id"].dataType.simpleString()
    if not texts:
        return _scan(rows.limit(0), ids, None, k, 0.0, kind)
    if ranker == "overlap":
        return _scan(rows, ids, Overlap(texts, ignored).score, k, -1.0, kind)
    vector = Trigram(texts) if ranker in ("trigram", "hybrid") else None
    if ranker == "trigram":
        return _scan(rows, ids, vector.score, k, 0.0, kind)
    lexical = Lexical(texts)
    _learn(rows, lexical)
    if ranker == "bm25":
        return _scan(rows, ids, lexical.score, k, 0.0, kind)
    top = {r["query_id"]: r["score"] for r in _scan(rows, ids, lexical.score, 1, 0.0, kind).collect()}
    most = np.array([top.get(q, 0.0) or np.inf for q in ids.to_pylist()])[:, None]
    return _scan(rows, ids, Hybrid(lexical, vector, most, weight).score, k, 0.0, kind)


def bounded_matches(chunks: DataFrame, gold: DataFrame, threshold: float, least: int) -> DataFrame:
    """``query_id, chunk_id, score``: passages whose bigrams overlap a gold text's, by those of the smaller side, ``least`` at least."""
    asked = gold.select("query_id", bigrams("text").alias("grams")).toArrow()
    ids, lists = asked["query_id"].combine_chunks(), asked["grams"].to_pylist()
    names = sorted({g for own in lists for g in own or ()})
    number = {g: i for i, g in enumerate(names)}
    pairs = np.array([(q, number[g]) for q, own in enumerate(lists) for g in own or ()], np.int64).reshape(-1, 2)
    want = Sparse(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)), len(names), len(lists))
    sizes = np.array([len(own or ()) for own in lists])
    shared = chunks.sparkSession.sparkContext.broadcast((ids, pa.array(names, pa.string()), want, sizes))
    rows = chunks.select("chunk_id", bigrams("text").alias("grams"))
    types = (gold.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, want, sizes = shared.value
        step = batch_rows(len(sizes))
        for batch in batches:
            for at in range(0, batch.num_rows if len(sizes) else 0, step):
                part = batch.slice(at, step)
                lists = part.column(1)
                row, known = np.asarray(pc.list_parent_indices(lists)), pc.index_in(pc.list_flatten(lists), value_set=vocabulary)
                have = np.asarray(known.is_valid())
                term = np.asarray(known.drop_null()).astype(np.int64)
                both = want.product(row[have], term, np.ones(len(term)), part.num_rows)
                own = np.bincount(row, minlength=part.num_rows)
                score = np.round(both / np.maximum(np.minimum(own, sizes[:, None]), least), 4)
                q, c = np.nonzero((score >= threshold) & (both > 0))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), part.column(0).take(pa.array(c)), pa.array(score[q, c])], ["query_id", "chunk_id", "score"])

    return rows.mapInArrow(run, f"query_id {types[0]}, chunk_id {types[1]}, score double")
