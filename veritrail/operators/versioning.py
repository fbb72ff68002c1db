"""Corpus versions, stale questions and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_corpus(before: DataFrame, after: DataFrame) -> DataFrame:
    """``chunk_id, change`` (new, changed, deleted, unchanged) of two ``chunk_id, hash`` tables."""
    both = before.select("chunk_id", F.col("hash").alias("old")).join(after.select("chunk_id", F.col("hash").alias("new")), "chunk_id", "full_outer")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return both.select("chunk_id", change.alias("change"))


def staleness(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``questions`` with their new status: stale unless every chunk is there unchanged; rejected ones stay rejected.

    ``questions``: question_id, chunk_ids, chunk_hashes, status.
    """
    parts = questions.where("status <> 'rejected'").select("question_id", F.explode(F.arrays_zip("chunk_ids", "chunk_hashes")).alias("p"))
    parts = parts.select("question_id", F.col("p.chunk_ids").alias("chunk_id"), F.col("p.chunk_hashes").alias("wanted"))
    held = parts.join(chunks.select("chunk_id", "hash"), "chunk_id", "left").groupBy("question_id").agg(F.bool_and(F.coalesce(F.col("hash") == F.col("wanted"), F.lit(False))).alias("current"))
    status = F.when(F.col("status") == "rejected", F.col("status")).when(F.coalesce("current", F.lit(True)), "active").otherwise("stale")
    return questions.join(held, "question_id", "left").withColumn("status", status).drop("current")


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate with map-side combining, no sort of the whole table."""
    value = F.struct(*order, *(c for c in rows.columns if c not in {*keys, *order}))
    last = rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("v")) if keys else rows.agg(F.max_by(value, F.struct(*order)).alias("v"))
    return last.select(*keys, "v.*").select(*rows.columns)


def _without(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the table whose key does not occur in ``rows``; null is a key like any other."""
    gone = rows.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return table.join(gone, same, "left_anti")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table has not, the first of each key: what an insert that keeps old rows adds."""
    return _without(rows, table, keys).dropDuplicates(keys)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The table with a row of each key of ``rows`` in place of its own: the last by ``order``, without an order any of them.

    Null is a key like any other.
    """
    last = latest_by(rows, keys, order) if order else rows.dropDuplicates(keys)
    return _without(table, rows, keys).unionByName(last)


def replace_by_key(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the keys that occur in ``rows`` replaced by theirs; saving twice changes nothing."""
    return _without(table, rows, [key]).unionByName(rows)


def update_status(table: DataFrame, ids: DataFrame, key: str, status: str, reason: str | None = None) -> DataFrame:
    """The table with a status, and reason, set where the key is among ``ids``; ``was_changed`` tells where."""
    marked = table.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    out = marked.withColumns({"was_changed": hit & ~F.col("status").eqNullSafe(F.lit(status)), "status": F.when(hit, F.lit(status)).otherwise(F.col("status"))})
    if "reject_reason" in table.columns:
        out = out.withColumn("reject_reason", F.when(hit, F.lit(reason)).otherwise(F.col("reject_reason")))
    return out.drop("__hit")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_of_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def migrate_splits(questions: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with splits by chunk id, cross-split ones rejected, and the cached results that still hold.

    ``questions``: question_id, chunk_ids, split, status, reject_reason.
    """
    from ..functions.ids import split_of_all

    new = questions.withColumn("new_split", split_of_all("chunk_ids"))
    crossed = F.col("new_split").isNull()
    moved = new.where(~F.col("new_split").eqNullSafe(F.col("split"))).select("question_id")
    out = new.withColumns({"status": F.when(crossed, "rejected").otherwise(F.col("status")), "reject_reason": F.when(crossed, "cross_split").otherwise(F.col("reject_reason")), "split": F.col("new_split")})
    return out.drop("new_split"), results.join(moved, "question_id", "left_anti")
