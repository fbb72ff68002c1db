"""Retrieval: scores of passages for queries, ranked lists, and matches with gold passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import share_threshold
from ..functions.text import MIN_BIGRAMS, STOPWORDS, bigram_match, bigrams, tokens_alnum
from ..plans.scratch import cut
from .ranking import DIGITS, K1, B, best_passages, bounded, bounded_matches

MATCH_THRESHOLD = 0.5


def top_k(scored: DataFrame, k: int, query: str = "query_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each query with ``rank`` from 1; ties to the smaller id. Keeps k rows per task before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve(chunks: DataFrame, queries: DataFrame, k: int, ranker: str = "bm25", weight: float = 0.5) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the k best passages of each question by bm25, trigram, hybrid or overlap.

    A bounded set of questions is sent to the passages (:mod:`.ranking`). More questions than
    that meet the passages by joins on their terms, which shuffle a row for each question and
    passage that share one.
    """
    if bounded(queries):
        return best_passages(chunks, queries, k, ranker, weight, STOPWORDS if ranker == "overlap" else ())
    if ranker == "overlap":
        scored = overlap_scores(chunks, queries)
        # Passages that share nothing fill the places left: of the first 2 k ids at least k are not among those found.
        first = F.broadcast(chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k))
        others = queries.select("query_id").crossJoin(first).withColumn("score", F.lit(0.0))
        found = top_k(scored, k).select("query_id", "chunk_id", "score")
        scored = found.unionByName(others.join(found, ["query_id", "chunk_id"], "left_anti"))
    elif ranker == "hybrid":
        scored = hybrid(bm25(chunks, queries), trigram_cosine(chunks, queries), weight)
    else:
        scored = {"bm25": bm25, "trigram": trigram_cosine}[ranker](chunks, queries)
    return top_k(scored, k).select("query_id", "chunk_id", "score", "rank")


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score`` of all chunks that share a term with a query.

    ``chunks``: chunk_id, text; ``queries``: query_id, text. A term that a query repeats counts
    as often. One pass tokenises the chunks to (chunk, term, tf); document frequencies come
    from that; the inverse frequency is folded into the queries' term weights, which is the
    smaller side of the only join by term. Sums are made per (query, chunk) with map-side
    combining.
    """
    n_terms = F.size("terms")
    tokens = chunks.select("chunk_id", tokens_alnum("text").alias("terms")).withColumn("length", n_terms)
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    postings = tokens.select("chunk_id", "length", F.explode("terms").alias("term")).groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    asked = queries.select("query_id", F.explode(tokens_alnum("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = postings.join(asked.select("term").distinct(), "term", "left_semi")
    frequency = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weights = asked.join(frequency, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("times") * idf).alias("weight"), "mean")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return wanted.join(weights, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def trigram_rows(rows: DataFrame, key: str) -> DataFrame:
    """``key, gram, times, norm``: character trigrams of the normalised text with a space on either side."""
    text = F.concat(F.lit(" "), F.array_join(tokens_alnum("text"), " "), F.lit(" "))
    padded = rows.select(key, text.alias("t"))
    grams = padded.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 2, F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(3)))).alias("gram"))
    counted = grams.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("times"))
    norms = counted.groupBy(key).agg(F.sqrt(F.sum(F.col("times") * F.col("times"))).alias("norm"))
    return counted.join(norms, key)


def trigram_cosine(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score``: cosine of trigram counts, a sparse product by a join on the trigram."""
    left = trigram_rows(chunks, "chunk_id")
    right = trigram_rows(queries, "query_id").select("query_id", "gram", F.col("times").alias("q_times"), F.col("norm").alias("q_norm"))
    dot = left.join(right, "gram").groupBy("query_id", "chunk_id", "norm", "q_norm").agg(F.sum(F.col("times") * F.col("q_times")).alias("dot"))
    return dot.select("query_id", "chunk_id", F.round(F.col("dot") / (F.col("norm") * F.col("q_norm")), DIGITS).alias("score"))


def hybrid(lexical: DataFrame, vector: DataFrame, weight: float = 0.5) -> DataFrame:
    """(1 - weight) x lexical score by the query's best + weight x vector score; a missing score counts as 0."""
    best = Window.partitionBy("query_id")
    scaled = lexical.withColumn("lex", F.coalesce(F.col("score") / F.nullif(F.max("score").over(best), F.lit(0.0)), F.lit(0.0))).drop("score")
    both = scaled.join(vector.withColumnRenamed("score", "vec"), ["query_id", "chunk_id"], "full_outer")
    score = (1 - weight) * F.coalesce("lex", F.lit(0.0)) + weight * F.coalesce("vec", F.lit(0.0))
    return both.select("query_id", "chunk_id", F.round(score, DIGITS).alias("score"))


def rerank(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, source: str = "chunk_id") -> DataFrame:
    """Of the best 4k rows the first k distinct sources by the share of the query's words in the passage.

    The few ranked rows are written, so that Spark knows their size and broadcasts them if it is small.
    """
    first = cut(ranked.where(F.col("rank") <= 4 * k).select("query_id", "chunk_id", F.col("rank").alias("before")), "first")
    words = lambda c: F.array_distinct(tokens_alnum(c))
    asked = queries.select("query_id", words("text").alias("asked"))
    have = chunks.select("chunk_id", F.col(source).alias("source"), words("text").alias("have")) if source != "chunk_id" else chunks.select("chunk_id", F.col("chunk_id").alias("source"), words("text").alias("have"))
    shared = F.size(F.array_intersect("asked", "have")) / F.greatest(F.size("asked"), F.lit(1))
    scored = first.join(asked, "query_id").join(have, "chunk_id").withColumn("score", F.round(shared, DIGITS))
    by_source = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "before")
    best = scored.withColumn("n", F.row_number().over(by_source)).where("n = 1").drop("n")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def overlap_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score``: shared words that are no stopwords, by a join on the word."""
    words = lambda rows, key: rows.select(key, F.explode(F.array_distinct(F.filter(tokens_alnum("text"), lambda t: ~t.isin(*STOPWORDS)))).alias("word"))
    return words(chunks, "chunk_id").join(words(queries, "query_id"), "word").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).cast("double").alias("score"))


def degrade(ranked: DataFrame, ids: DataFrame, percent: int = 30, salt: str = "degraded") -> DataFrame:
    """For a repeatable share of the queries, every chunk is replaced by one chosen by hash.

    ``ids`` is the table of all chunk ids with ``number`` from 0; the choice needs only its count.
    """
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    rows = ranked.crossJoin(F.broadcast(total)).withColumn("swap", share_threshold(F.col("query_id").cast("string"), salt, percent))
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.col("query_id").cast("string"), F.col("rank").cast("string")), 256), 1, 8), 16, 10).cast("bigint") % F.col("total")
    swapped = rows.withColumn("number", F.when(F.col("swap"), pick)).join(ids.select("number", F.col("chunk_id").alias("other")), "number", "left")
    return swapped.withColumn("chunk_id", F.coalesce("other", "chunk_id")).select("query_id", "rank", "chunk_id", "swap")


# --- matches -----------------------------------------------------------------------------


def id_rank(gold: Column, retrieved: Column) -> Column:
    """0-based place of the gold id in the list, or null."""
    at = F.array_position(retrieved, gold)
    return F.when(at > 0, at - 1)


def recall_at_k(gold: Column, retrieved: Column, k: int) -> dict[str, Column]:
    """``recall``, ``reciprocal_rank`` and ``hit`` (all found) among the first k ids."""
    top = F.slice(retrieved, 1, k)
    wanted = F.array_distinct(gold)
    found = F.size(F.array_intersect(wanted, top))
    places = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains(wanted, x), i + 1)), lambda p: p.isNotNull())
    return {
        "recall": F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(0.0),
        "reciprocal_rank": F.coalesce(1.0 / F.array_min(places), F.lit(0.0)),
        "hit": (F.size(wanted) > 0) & (found == F.size(wanted)),
    }


def text_recall_at_k(rows: DataFrame, chunks: DataFrame, k: int, threshold: float = MATCH_THRESHOLD, key: str = "question_id") -> DataFrame:
    """``rows`` (chunk_ids, contexts) with ``recall, reciprocal_rank, hit`` by text: a gold chunk is found where one of the first k contexts overlaps it.

    The rank is that of the first such context of any gold chunk. A gold chunk that is not in
    ``chunks`` (chunk_id, text) is an error; a question without gold chunks has 0, 0 and false.
    """
    from .cases import gold_texts

    gold = gold_texts(rows.select(key, F.explode(F.array_distinct("chunk_ids")).alias("chunk_id")), chunks).select(key, "chunk_id", bigrams("text").alias("want"))
    shown = rows.select(key, F.posexplode(F.slice("contexts", 1, k)).alias("place", "context")).select(key, "place", bigrams("context").alias("have"))
    met = gold.join(shown, key, "left").withColumn("place", F.when(bigram_match(F.col("want"), F.col("have")) >= threshold, F.col("place") + 1))
    first = met.groupBy(key, "chunk_id").agg(F.min("place").alias("place"))
    found = first.groupBy(key).agg((F.count("place") / F.count(F.lit(1))).alias("recall"), F.coalesce(1.0 / F.min("place"), F.lit(0.0)).alias("reciprocal_rank"))
    out = rows.join(found, key, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("recall", "reciprocal_rank")})
    return out.withColumn("hit", F.col("recall") == 1.0)


def match_contexts(contexts: DataFrame, gold: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """``query_id, match_rank, match_score``: the first context that overlaps the gold text, and the best overlap.

    ``contexts``: query_id, rank, text; ``gold``: query_id, text. Only a query's own contexts
    are compared with its own gold text.
    """
    own = contexts.select("query_id", "rank", bigrams("text").alias("have")).join(gold.select("query_id", bigrams("text").alias("want")), "query_id")
    scored = own.withColumn("score", bigram_match(F.col("want"), F.col("have")))
    return scored.groupBy("query_id").agg(F.min(F.when(F.col("score") >= threshold, F.col("rank"))).alias("match_rank"), F.round(F.max("score"), 4).alias("match_score"))


def corpus_matches(chunks: DataFrame, gold: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """``query_id, chunk_id, score`` of all chunks that overlap a gold text: in one pass if the gold texts are bounded, else by an inverted list."""
    if bounded(gold):
        return bounded_matches(chunks, gold, threshold, MIN_BIGRAMS)
    have = chunks.select("chunk_id", bigrams("text").alias("grams")).select("chunk_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    want = gold.select("query_id", bigrams("text").alias("grams")).select("query_id", F.size("grams").alias("m"), F.explode("grams").alias("gram"))
    shared = have.join(want, "gram").groupBy("query_id", "chunk_id", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    score = F.col("shared") / F.greatest(F.least("n", "m"), F.lit(8))
    return shared.select("query_id", "chunk_id", F.round(score, 4).alias("score")).where(F.col("score") >= threshold)
