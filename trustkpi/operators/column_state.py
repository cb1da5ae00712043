"""State of every column from one pass over the rows, merged per (keys, column)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi.operators.keyed import Keys, attach, cols
from trustkpi.session import stage

# A sketch counts up to 2**SKETCH_BITS distinct values exactly; beyond, it proves that there are at least as many.
SKETCH_BITS = 13


def exact_limit() -> int:
    return 1 << SKETCH_BITS


def long_rows(df: DataFrame, keys: Keys, columns: Sequence[str]) -> DataFrame:
    """(keys, column, value): one row per cell."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    return df.select(*cols(keys), F.inline(pairs))


def column_state(cells: DataFrame, keys: Keys, measures: Sequence[Column]) -> DataFrame:
    """(keys, column, rows, non_null, at_least, measures …) of the cells, staged.

    Cells become rows inside a task only: what leaves it is one state per column, a few counters and
    a sketch, whatever the number of values. ``at_least`` is the number of distinct values if it
    is under ``exact_limit()``, else a number not under that limit, which as many values reach.
    """
    found = cells.groupBy(*cols(keys), "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("non_null"), *measures,
        F.theta_sketch_agg("value", F.lit(SKETCH_BITS)).alias("_sketch"),
    )
    return stage(
        found.withColumn("at_least", F.theta_sketch_estimate("_sketch").cast("bigint")).drop("_sketch"), "column-state"
    )


def with_distinct(
    state: DataFrame, cells: Callable[[list[str]], DataFrame], keys: Keys, matters: Column
) -> DataFrame:
    """``state`` with ``distinct``, exact wherever the sketch was or ``matters`` holds, else NULL for "too many".

    Only columns still open are read again, as ``cells`` of their names, and only their digests are shuffled.
    Staged then, because several results ask for the counts.
    """
    state = state.withColumn("_open", (F.col("at_least") >= exact_limit()) & matters)
    known = F.when(F.col("at_least") < exact_limit(), F.col("at_least"))
    # At most the names of the table's columns.
    names = [r[0] for r in state.where("_open").select("column").distinct().collect()]
    if not names:
        return state.withColumn("distinct", known).drop("_open")
    asked = state.where("_open").select(*cols([*keys, "column"]), F.lit(True).alias("_asked"))
    values = attach(cells(names).where(F.col("value").isNotNull()), asked, [*keys, "column"])
    digests = values.where("_asked").select(*cols([*keys, "column"]), F.unhex(F.md5("value")).alias("_digest")).distinct()
    counts = digests.groupBy(*cols([*keys, "column"])).agg(F.count(F.lit(1)).alias("_exact"))
    found = attach(state, counts, [*keys, "column"])
    return stage(
        found.withColumn("distinct", F.when(F.col("_open"), F.col("_exact")).otherwise(known)).drop("_open", "_exact"),
        "distinct",
    )
