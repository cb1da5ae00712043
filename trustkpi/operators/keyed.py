"""Helpers that let one code path serve one dataset or many."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


def attach(df: DataFrame, per_key: DataFrame, keys: Keys) -> DataFrame:
    """Add the columns of ``per_key`` (one row per key) to every row of ``df``.

    Without keys the single row arrives as a scalar subquery. With keys it is a
    null-safe equi-join with no hint: the planner broadcasts the small side
    only when its known size is under the session's threshold, and otherwise
    shuffles, where adaptive execution splits hot keys.
    """
    extra = [c for c in per_key.columns if c not in keys]
    if not keys:
        row = per_key.select(F.struct(*[F.col(f"`{c}`") for c in extra]).alias("row")).scalar()
        names = df.columns
        wide = df.withColumn("_row", row)
        return wide.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"_row.`{c}`") for c in extra])
    right = per_key.select(
        *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in extra],
    )
    same = reduce(
        lambda a, b: a & b,
        [df[f"`{k}`"].eqNullSafe(right[f"_key{i}"]) for i, k in enumerate(keys)],
    )
    return df.join(right, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def data_columns(df: DataFrame, keys: Keys, *internal: str) -> list[str]:
    return [c for c in df.columns if c not in keys and c not in internal]


def cols(names: Sequence[str]) -> list:
    """Columns by exact name; headers may hold blanks and dots."""
    return [F.col(f"`{n}`") for n in names]
