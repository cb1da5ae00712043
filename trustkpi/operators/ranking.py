"""Exact order statistics and running totals without one-task sorts.

A plain window or exact percentile would pull a hot key, or a whole keyless
table, into one task. These use only aggregations whose groups are bounded by
a constant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustkpi.operators.keyed import Keys, attach, cols
from trustkpi.operators.running import running_total
from trustkpi.session import stage

_FAN_BITS = 16


def order_statistics(
    df: DataFrame, keys: Keys, value: Column, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Exact n-th smallest values per key.

    ``ranks`` maps an output name to a function of the group size that gives a
    1-based rank. Equal values are counted together before anything is sorted, the
    input is read once, and the counts are summed range by range. Output per name:
    the value and ``<name>_below``, the number of rows smaller than it.
    """
    base = df.select(*cols(keys), value.cast("double").alias("_v")).where("_v IS NOT NULL")
    counts = stage(base.groupBy(*cols(keys), "_v").agg(F.count(F.lit(1)).alias("_c")), "counts")
    sizes = stage(counts.groupBy(*cols(keys)).agg(F.sum("_c").alias("n")), "sizes")
    placed = attach(running_total(counts, keys, ["_v"], "_c", "_below"), sizes, keys)
    found = []
    for name, rank in ranks.items():
        wanted = rank(F.col("n")).cast("bigint")
        here = (F.col("_below") < wanted) & (wanted <= F.col("_below") + F.col("_c"))
        found += [
            F.max(F.when(here, F.col("_v"))).alias(name), F.max(F.when(here, F.col("_below"))).alias(f"{name}_below")
        ]
    return placed.groupBy(*cols(keys)).agg(F.max("n").alias("n"), *found)


def exact_median(df: DataFrame, keys: Keys, value: Column, name: str = "median") -> DataFrame:
    found = order_statistics(
        df, keys, value, {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.ceil((n + 1) / 2)}
    )
    return found.select(*cols(keys), (F.col("low") / 2 + F.col("high") / 2).alias(name))


def take_lowest(
    df: DataFrame,
    keys: Keys,
    draw: Column,
    tie_break: str,
    how_many: Callable[[Column], Column],
    name: str,
) -> DataFrame:
    """Flag exactly ``how_many(group size)`` rows per key, those with the lowest draw.

    Only rows that share the boundary draw are ordered by ``tie_break``; the
    draws are 52-bit hashes, so that set is tiny.
    """
    drawn = df.withColumn("_draw", draw.cast("double"))
    cut = order_statistics(drawn, keys, F.col("_draw"), {"_cut": how_many})
    limits = cut.withColumn("_want", how_many(F.col("n")).cast("bigint")).drop("n")
    marked = attach(drawn, stage(limits, "cut"), keys)
    at_cut = F.col("_draw") == F.col("_cut")
    order = Window.partitionBy(*cols(keys), "_draw").orderBy(tie_break)
    ties = marked.where(at_cut).withColumn("_tie", F.row_number().over(order))
    chosen_ties = ties.withColumn(name, F.col("_tie") <= F.col("_want") - F.col("_cut_below")).drop("_tie")
    rest = marked.where(~F.coalesce(at_cut, F.lit(False))).withColumn(
        name, F.coalesce(F.col("_draw") < F.col("_cut"), F.lit(False))
    )
    return rest.unionByName(chosen_ties).drop("_draw", "_cut", "_cut_below", "_want")


def running_totals(df: DataFrame, position: str, measures: dict[str, Column]) -> DataFrame:
    """Totals of each measure over all rows up to and including ``position``.

    ``position`` is a unique non-negative whole number. Its bits split the rows
    into blocks of at most 65536; block totals are summed the same way one
    level up, so every window partition stays bounded.
    """
    names = list(measures)
    rows = df.select("*", *[measures[m].cast("double").alias(f"_m_{m}") for m in names])
    level = rows.select(F.col(position).alias("_p"), *[f"_m_{m}" for m in names])
    levels = []
    for depth in (1, 2, 3):
        block = F.shiftright(F.col(position), _FAN_BITS * depth)
        levels.append(
            rows.groupBy(block.alias("_p")).agg(*[F.sum(f"_m_{m}").alias(f"_m_{m}") for m in names])
        )
    before = None
    for lower in [levels[2], levels[1], levels[0], level]:
        parent = F.shiftright(F.col("_p"), _FAN_BITS)
        upto = Window.partitionBy("_block").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        inner = lower.withColumn("_block", parent).select(
            "_p", "_block", *[f"_m_{m}" for m in names],
            *[F.sum(f"_m_{m}").over(upto).alias(f"_c_{m}") for m in names],
        )
        if before is not None:
            inner = inner.join(before, "_block", "left")
            inner = inner.select(
                "_p", *[f"_m_{m}" for m in names],
                *[(F.col(f"_c_{m}") + F.col(f"_b_{m}")).alias(f"_c_{m}") for m in names],
            )
        before = inner.select(
            F.col("_p").alias("_block"),
            *[(F.col(f"_c_{m}") - F.col(f"_m_{m}")).alias(f"_b_{m}") for m in names],
        )
        last = inner
    totals = last.select(F.col("_p").alias(position), *[F.col(f"_c_{m}").alias(m) for m in names])
    return df.join(totals, position, "left")
