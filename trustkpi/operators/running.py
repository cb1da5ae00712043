"""Exact running totals over any number of rows, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustkpi.operators.keyed import attach, cols
from trustkpi.session import stage


def running_total(rows: DataFrame, by: Sequence[str], order: Sequence[str], weight: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` over the rows before it in its group.

    Rows are dealt to ranges of (by, order), so a large group spreads over many ranges.
    Sums per range give each range its start; only one range is sorted at a time. The
    columns ``by`` and ``order`` must identify a row.
    """
    dealt = stage(
        rows.repartitionByRange(*cols([*by, *order])).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    ahead = Window.partitionBy(*cols(by)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*cols([*by, "_range"])).agg(F.sum(weight).alias("_sum"))
        .select(*cols([*by, "_range"]), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*cols(["_range", *by])).orderBy(*cols(order)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        attach(dealt, starts.hint("merge"), ["_range", *by])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_range", "_start")
    )
