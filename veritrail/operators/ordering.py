"""Numbers and running sums over a whole table, without one task for all of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut

_PART, _FIRST, _BEFORE = "__range", "__first", "__before"


def _ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in ranges of ``order``, written once, with the number of their range."""
    ids = rows.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id())
    return cut(ids, "ranges")


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their place from 0 in the order of ``order``.

    Rows are dealt into ranges; each is numbered by itself, and the sizes of the ranges before
    it, one row a range, are added.
    """
    return running_sum(rows.withColumn(name, F.lit(1).cast("bigint")), order, name, name).withColumn(name, F.col(name) - 1)


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row, in the order of ``order``, by which no two rows should be equal."""
    dealt = _ranges(rows, order)
    totals = dealt.groupBy(_PART).agg(F.sum(value).alias(_FIRST))
    ahead = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PART, F.coalesce(F.sum(_FIRST).over(ahead), F.lit(0)).alias(_BEFORE))
    own = F.sum(value).over(Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn(name, own).join(F.broadcast(offsets), _PART)
    return summed.withColumn(name, F.col(name) + F.col(_BEFORE)).drop(_PART, _BEFORE)
