"""Period series: bucket, fill gaps with zero, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions.periods import Period, period
from trustkpi.operators.keyed import Keys, attach, cols
from trustkpi.session import stage

# Periods per block: bounds the spine arrays and the rolling window partitions.
BLOCK = 4096


def bucket(
    df: DataFrame, freq: str | Period = "D", keys: Keys = (), date: str = "date", value: str = "revenue"
) -> DataFrame:
    """Sum of ``value`` and row count per non-empty period: (keys, _ix, revenue, rows).

    The only pass over the rows; sums are combined before the shuffle. The
    result is staged, since bounds, statistics and output all read it.
    """
    p = freq if isinstance(freq, Period) else period(freq)
    d, v = F.col(f"`{date}`"), F.col(f"`{value}`")
    known = df.where(d.isNotNull() & v.isNotNull())
    fine = known.groupBy(*cols(keys), p.index(d).alias("_ix")).agg(
        F.sum(v.cast("double")).alias("revenue"), F.count(F.lit(1)).alias("rows")
    )
    fine = stage(fine, "series")
    if not p.rebins:
        return fine
    first = fine.groupBy(*cols(keys)).agg(p.origin(F.min("_ix")).alias("_origin"))
    return (
        attach(fine, first, keys)
        .groupBy(*cols(keys), p.bin(F.col("_ix"), F.col("_origin")).alias("_ix"))
        .agg(F.sum("revenue").alias("revenue"), F.sum("rows").alias("rows"))
    )


def spine(buckets: DataFrame, p: Period, keys: Keys = ()) -> DataFrame:
    """(keys, _ix): every period between a key's first and last one.

    Blocks of periods are dealt to all tasks before they are opened, so one very long series is as
    much work for each task as many short ones. The number of tasks is given because the
    planner would see only the few bytes of the blocks.
    """
    step = p.multiple
    bounds = buckets.groupBy(*cols(keys)).agg(F.min("_ix").alias("_lo"), F.max("_ix").alias("_hi"))
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bounds.select(
        *cols(keys), "_hi", F.explode(F.sequence("_lo", "_hi", F.lit(BLOCK * step))).alias("_b")
    ).repartition(tasks, *cols(keys), "_b")
    last = F.least(F.col("_b") + (BLOCK - 1) * step, F.col("_hi"))
    return blocks.select(*cols(keys), F.explode(F.sequence(F.col("_b"), last, F.lit(step))).alias("_ix"))


def fill_gaps(buckets: DataFrame, p: Period, keys: Keys = ()) -> DataFrame:
    """Add a zero row for every empty period between a key's first and last."""
    empty = spine(buckets, p, keys).select("*", F.lit(0.0).alias("revenue"), F.lit(0).cast("bigint").alias("rows"))
    return (
        buckets.unionByName(empty)
        .groupBy(*cols(keys), "_ix")
        .agg(F.sum("revenue").alias("revenue"), F.sum("rows").alias("rows"))
    )


def period_series(
    df: DataFrame, freq: str = "D", keys: Keys = (), date: str = "date", value: str = "revenue"
) -> DataFrame:
    """Dense series (keys, period, revenue, rows)."""
    p = period(freq)
    dense = fill_gaps(bucket(df, p, keys, date, value), p, keys)
    return dense.select(*cols(keys), p.label(F.col("_ix")).alias("period"), "revenue", "rows")


def rolling(dense: DataFrame, p: Period, keys: Keys, width: int) -> DataFrame:
    """Trailing mean, deviation and count over ``width`` periods, and the period before as ``previous``.

    Window partitions are blocks of the series; each block also receives the
    last rows of the one before that they need, so results equal one long window.
    """
    size = max(BLOCK, width) * p.multiple
    reach = max(width - 1, 1) * p.multiple
    home = F.floor(F.col("_ix") / size)
    shared = dense.withColumn(
        "_blk", F.explode(F.array_distinct(F.array(home, F.floor((F.col("_ix") + reach) / size))))
    )
    trail = Window.partitionBy(*cols(keys), "_blk").orderBy("_ix").rowsBetween(-(width - 1), 0)
    return (
        shared.select(
            "*",
            F.avg("revenue").over(trail).alias("roll_mean"),
            F.stddev_pop("revenue").over(trail).alias("roll_std"),
            F.count("revenue").over(trail).alias("roll_n"),
            F.lag("revenue").over(Window.partitionBy(*cols(keys), "_blk").orderBy("_ix")).alias("previous"),
        )
        .where(F.col("_blk") == home)
        .drop("_blk")
    )


def score(
    dense: DataFrame,
    p: Period,
    keys: Keys = (),
    threshold: float = fixed.ANOMALY_THRESHOLD,
    width: int = fixed.ROLLING_WINDOW,
) -> DataFrame:
    """Add ``z_score``, ``rolling_dev``, ``is_anomaly``, ``previous`` and the series' last index.

    A series of fewer than three periods, or without variation, has no
    anomalies and NULL scores.
    """
    stats = dense.groupBy(*cols(keys)).agg(
        F.avg("revenue").alias("_mean"),
        F.stddev_pop("revenue").alias("_std"),
        F.count(F.lit(1)).alias("_periods"),
        F.max("_ix").alias("_last"),
    )
    scored = attach(rolling(dense, p, keys, width), stats, keys)
    usable = (F.col("_periods") >= 3) & (F.col("_std") > 0)
    z = F.when(usable, F.abs(F.col("revenue") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0)))
    trailing = F.abs(F.col("revenue") - F.col("roll_mean")) / F.nullif(F.col("roll_std"), F.lit(0.0))
    dev = F.when(usable, F.coalesce(F.when(F.col("roll_n") >= 2, trailing), F.lit(0.0)))
    hit = F.coalesce((z > threshold) | (dev > threshold), F.lit(False))
    return scored.select("*", z.alias("z_score"), dev.alias("rolling_dev"), hit.alias("is_anomaly")).drop(
        "roll_mean", "roll_std", "roll_n", "_mean", "_std"
    )


def scored_series(
    df: DataFrame,
    freq: str = "D",
    keys: Keys = (),
    threshold: float = fixed.ANOMALY_THRESHOLD,
    width: int = fixed.ROLLING_WINDOW,
    value: str = "revenue",
) -> DataFrame:
    """Dense scored series: (keys, _ix, period, revenue, rows, z_score, …)."""
    p = period(freq)
    dense = fill_gaps(bucket(df, p, keys, value=value), p, keys)
    return score(dense, p, keys, threshold, width).withColumn("period", p.label(F.col("_ix")))


def last_two(p: Period) -> tuple[Column, Column]:
    """Aggregates for the last period's and the previous period's revenue."""
    current = F.sum(F.when(F.col("_ix") == F.col("_last"), F.col("revenue")))
    previous = F.sum(F.when(F.col("_ix") == F.col("_last") - p.multiple, F.col("revenue")))
    return current, previous
