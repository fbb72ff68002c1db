"""Corpora from text directories and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import hash_content, stable_chunk_id
from ..functions.text import parse_timestamp
from ..operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_fixed
from ..operators.ordering import numbered
from ..operators.versioning import duplicate_keys


def scan_text_dir(spark: SparkSession, root: str) -> DataFrame:
    """``path, text, content_hash, doc_id`` of all .txt and .md files (in any case) below a folder.

    Files that are no UTF-8 are left out. ``path`` is relative to the folder. Hidden and empty
    files are not listed by Spark.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    place = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", "")
    rows = files.where(F.lower("path").rlike(r"\.(txt|md)$")).where(F.expr("is_valid_utf8(cast(content AS string))"))
    rows = rows.select(F.substring(place, len(full) + 1, 1 << 20).alias("path"), F.col("content").cast("string").alias("text"))
    hashed = rows.withColumn("content_hash", hash_content("text"))
    return hashed.withColumn("doc_id", F.sha2(F.concat_ws(":", "path", "content_hash"), 256))


def scan_dir_corpus(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``chunk_id, doc_id, position, text`` of ``path, text`` documents; ids are path and position."""
    chunks = chunk_fixed(docs.select("path", "text"), "text", size, overlap)
    return chunks.select(stable_chunk_id("path", "position").alias("chunk_id"), F.col("path").alias("doc_id"), "position", "text")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, value`` of one JSON-lines file, lines counted from 1 across its splits."""
    lines = spark.read.text(path).withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.file_block_start")})
    from pyspark.sql import Window

    inside = lines.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    sizes = inside.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(offsets), "__part").select((F.col("before") + F.col("__id") - F.col("first") + 1).alias("line"), "value")


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """``line, chunk_id, doc_id, position, text, timestamp, metadata, problem`` of ``line, value`` rows.

    Blank lines are left out. ``problem`` names what is wrong with a line, else null. A missing
    doc_id is the chunk_id; a missing position is the number of chunks before. Further string
    fields go to ``metadata``, others are dropped.
    """
    rows = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    known = ("chunk_id", "text", "doc_id", "position", "timestamp")
    get = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    stamp = get("timestamp")
    parts = rows.withColumns({"chunk_id": F.when(kind("chunk_id") == "STRING", get("chunk_id")), "text": F.when(kind("text") == "STRING", get("text")), "stamp": stamp, "doc": get("doc_id"), "pos": get("position", "int")})
    problem = (
        F.when(F.col("v").isNull(), "invalid JSON")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object")
        .when(F.coalesce("chunk_id", F.lit("")) == "", "missing chunk_id")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank text")
        .when(F.col("stamp").isNotNull() & parse_timestamp("stamp").isNull(), "timestamp is not ISO 8601")
    )
    # The type of each value comes from the value itself: its JSON text begins with a quote if it is a string.
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    strings = F.map_filter(fields, lambda k, v: ~k.isin(*known) & (F.schema_of_variant(v) == "STRING"))
    strings = F.transform_values(strings, lambda k, v: F.try_variant_get(v, "$", "string"))
    # As many chunks lie before a line as lines do that aren't blank.
    parts = numbered(parts, ["line"], "__place")
    place = F.col("__place")
    return parts.select("line", "chunk_id", F.coalesce("doc", "chunk_id").alias("doc_id"), F.coalesce("pos", place.cast("int")).alias("position"), "text", parse_timestamp("stamp").alias("timestamp"), strings.alias("metadata"), problem.alias("problem"))


def load_corpus(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Chunks of a JSON-lines file or of a directory; a bad line or a chunk id that occurs twice is an error."""
    if lines:
        rows = parse_jsonl(numbered_lines(spark, path))
        bad = rows.where("problem IS NOT NULL").orderBy("line").head(1)
        if bad:
            raise ValueError(f"line {bad[0]['line']}: {bad[0]['problem']}")
        chunks = rows.drop("problem", "line")
    else:
        chunks = scan_dir_corpus(scan_text_dir(spark, path))
    twice = duplicate_keys(chunks, "chunk_id").head(1)
    if twice:
        raise ValueError(f"chunk id {twice[0]['chunk_id']} occurs {twice[0]['n']} times")
    return chunks
