"""Parquet tables of a store, written whole or by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.versioning import insert_ignore, upsert

SCHEMA_VERSION = 3


class Store:
    """Tables below one folder. Each save writes a new version and then names it as the current one.

    A reader keeps the version that it began with, and a lost job leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self, name: str):
        return self._path(f"{self.root}/{name}/CURRENT")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._pointer(name))

    def read(self, name: str) -> DataFrame:
        """The current version of a table."""
        rows = self.spark.read.text(f"{self.root}/{name}/CURRENT").head(1)
        return self.spark.read.parquet(f"{self.root}/{name}/{rows[0][0]}")

    def replace(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        """Replaces the whole table."""
        version = uuid.uuid4().hex
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.root}/{name}/{version}")
        out = self._fs.create(self._pointer(name), True)
        try:
            out.write(bytearray(version.encode()))
        finally:
            out.close()

    def insert_new(self, name: str, rows: DataFrame, keys: list[str]) -> int:
        """Adds rows of unknown keys; returns their number."""
        if not self.exists(name):
            fresh = rows.dropDuplicates(keys)
            self.replace(name, fresh)
            return self.read(name).count()
        table = self.read(name)
        before = table.count()
        self.replace(name, table.unionByName(insert_ignore(table, rows, keys)))
        return self.read(name).count() - before

    def save(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Adds rows, in place of those with the same keys."""
        self.replace(name, upsert(self.read(name), rows, keys) if self.exists(name) else rows)


class LockedSplit(PermissionError):
    """Rows of the exam split were asked for."""


def dev_view(questions: DataFrame) -> DataFrame:
    """The practice questions; the only rows that a search may see."""
    return questions.where("split = 'dev'")


def exam_summary(results: DataFrame) -> DataFrame:
    """Aggregates of the exam results; rows are never returned."""
    from ..operators.scoring import eval_summary

    return eval_summary(results.where("split = 'test'"))


def guarded(questions: DataFrame, splits: tuple[str, ...], statuses: tuple[str, ...], unlocked: bool = False) -> DataFrame:
    """Questions of splits and statuses, oldest first; exam rows that are not rejected need the lock to be open."""
    if "test" in splits and set(statuses) - {"rejected"} and not unlocked:
        raise LockedSplit("exam questions are scored through exam_summary only")
    return questions.where(questions["split"].isin(*splits) & questions["status"].isin(*statuses)).orderBy("created_at", "question_id")
