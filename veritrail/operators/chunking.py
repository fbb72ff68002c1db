"""Documents to chunks. Chunks of a document are made where the document is; nothing is shuffled."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 800, 100


def _check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")


def chunk_fixed(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``docs`` with a row for each window of ``size`` characters; ``position`` and the window's ``text`` replace the text.

    Windows start every ``size - overlap`` characters while there is text, so the last may lie
    inside the one before. Null and empty texts have none.
    """
    _check_window(size, overlap)
    step = size - overlap
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    rows = docs.where(F.length(text) > 0).select("*", F.posexplode(starts).alias("position", "__start"))
    return rows.withColumn(text, F.expr(f"substring(`{text}`, __start + 1, {size})")).drop("__start")


def chunk_words(docs: DataFrame, text: str = "text", size: int = 120, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` words; the first that reaches the end is the last."""
    _check_window(size, overlap)
    step = max(1, size - overlap)
    words = docs.withColumn("__words", F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != ""))
    n = F.size("__words")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
    rows = words.where(n > 0).select("*", F.posexplode(starts).alias("position", "__start"))
    return rows.withColumn(text, F.array_join(F.slice("__words", F.col("__start") + 1, F.lit(size)), " ")).drop("__start", "__words")


def chunk_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Parts between blank lines, white space folded; empty ones are left out and not counted."""
    folded = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return docs.where(F.col(text).isNotNull()).select("*", F.posexplode(F.filter(folded, lambda p: p != "")).alias("position", "__part")).withColumn(text, F.col("__part")).drop("__part")


def chunk_pack(docs: DataFrame, text: str = "text", most: int = 800) -> DataFrame:
    """Paragraphs packed in order up to ``most`` characters; longer ones are cut at sentences, then anywhere."""
    hard = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(most)), lambda at: F.substring(s, at + 1, F.lit(most)))
    folded = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    units = F.flatten(F.transform(folded, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.flatten(F.transform(F.split(p, r"(?<=[.!?])\s+"), hard)))))
    starts = _part_starts(most)(F.transform("__units", F.length))
    joined = F.transform(F.col("__starts"), lambda s, i: F.array_join(F.slice("__units", s + 1, F.coalesce(F.try_element_at("__starts", i + 2), F.size("__units")) - s), "\n"))
    rows = docs.where(F.col(text).isNotNull()).withColumn("__units", units).withColumn("__starts", starts).select("*", F.posexplode(joined).alias("position", "__part"))
    return rows.withColumn(text, F.col("__part")).drop("__part", "__units", "__starts")


def _part_starts(most: int):
    """From the lengths of units the place of the first unit of each part. It depends on all before it, so it is a loop, over lengths only."""

    @F.arrow_udf("array<int>")
    def starts(lengths: pa.Array) -> pa.Array:
        out = []
        for sizes in lengths.to_pylist():
            own, size = [], 0
            for i, n in enumerate(sizes or ()):
                if i and size + 1 + n <= most:
                    size += 1 + n
                else:
                    own.append(i)
                    size = n
            out.append(own)
        return pa.array(out, pa.list_(pa.int32()))

    return starts
