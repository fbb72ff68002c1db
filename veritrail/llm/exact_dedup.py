"""Exact deduplication with a split of frequent digests, in DataFrame operations only.

A frequent-items sketch (the mergeable form of Misra-Gries counters) names digests that may be
frequent. Their exact counts and winners are then computed with map-side combining - a few
rows per task - and broadcast, so no row of a large group of copies is ever shuffled. All
other digests take the ordinary shuffle by digest; the sketch bounds the size of their groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, spare, table

#: Counters of a sketch, and sketches that all rows are counted in.
COUNTERS, SKETCH_TASKS = 8192, 64
#: Frequent digests at most; with 40 bytes each this bounds the broadcast. Held by over 1/HEAVY of
#: the rows, a digest is over that share of some sketch's rows, and so among those it lists.
HEAVY = 2000
#: Copies from which a digest counts as frequent.
HEAVY_COUNT = 32


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, short``: SHA-256 of every whole text in UTF-8, null counting as empty, and 64 bits of it to count by."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return rows.withColumn("short", F.xxhash64("digest"))


def frequent_digests(keys: DataFrame, counters: int = COUNTERS, most: int = HEAVY, least: int = HEAVY_COUNT) -> DataFrame:
    """``digest, keep_id, group_size`` of the frequent digests: candidates of the sketch, verified exactly.

    At most ``most`` rows, whatever the input.
    """
    by_task = keys.groupBy((F.spark_partition_id() % SKETCH_TASKS).alias("task")).agg(F.expr(f"approx_top_k(short, {most}, {counters})").alias("top"))
    counted = by_task.select(F.explode("top").alias("entry")).groupBy(F.col("entry.item").alias("short")).agg(F.sum("entry.count").alias("n"))
    named = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "short").limit(most).select("short")
    return (
        keys.join(F.broadcast(named), "short", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty. Of equal texts the
    row with the largest id stays (``kept``). Rows that repeat that id are the same document:
    all of them are marked as kept, and ``group_size`` counts every row. A null id is smaller
    than any other; a group with only null ids keeps them. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    keys = cut(digests(docs, id_col, text_col), "digests")
    heavy = cut(frequent_digests(keys), "heavy")
    common = keys.join(F.broadcast(heavy), "digest")
    others = keys.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = others.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rare = others.join(groups, "digest").select(*common.columns)
    return common.unionByName(rare).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the copies that :func:`exact_groups` drops.

    A row goes by its id and its text together: another text of the same id stays. A null id is
    an id like any other here, so a copy without one goes where a copy with one stays, and where
    no copy has an id they all stay. Rows that repeat the staying one stay with it. Null and
    empty texts are equal. An empty table gives no rows; columns may have any names.
    """
    gone_id, gone_digest = spare(docs, "gone_id"), spare(docs, "gone_digest")
    dropped = exact_groups(docs, id_col, text_col).where(~F.col("kept"))
    gone = dropped.select(F.col("doc_id").alias(gone_id), F.unhex("text_sha256").alias(gone_digest)).distinct()
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    return docs.join(gone, docs[id_col].eqNullSafe(gone[gone_id]) & (digest == gone[gone_digest]), "left_anti")


def op2_exact_dedup(spark, sf_dir):
    """Groups of equal texts of ``documents``, by :func:`exact_groups`."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
