"""Repeatable random draws: functions of a row id, a seed and a slot name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustkpi.functions.text import text_array


def _digest(row_id: Column, seed: int, slot: str, word: Column | None = None) -> Column:
    # Seed and slot are one literal; a missing id leaves out its part.
    head = F.coalesce(F.concat(row_id.cast("string"), F.lit("|")), F.lit(""))
    tail = F.lit(f"{seed}|{slot}")
    return F.md5(F.concat(head, tail) if word is None else F.concat(head, tail, word))


def draw(row_id: Column, seed: int, slot: str) -> Column:
    """Whole number from 0 to 2^32 - 1."""
    return F.conv(F.substring(_digest(row_id, seed, slot), 1, 8), 16, 10).cast("bigint")


def wide_draw(row_id: Column, seed: int, slot: str) -> Column:
    """Whole number from 0 to 2^52 - 1, exact as a double."""
    return F.conv(F.substring(_digest(row_id, seed, slot), 1, 13), 16, 10).cast("bigint")


def chance(row_id: Column, seed: int, slot: str, percent: int) -> Column:
    return draw(row_id, seed, slot) % 100 < percent


def between(row_id: Column, seed: int, slot: str, low: Column | int, high: Column | int) -> Column:
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + draw(row_id, seed, slot) % (high - low + 1)).cast("int")


def choice(row_id: Column, seed: int, slot: str, values: Column) -> Column:
    return F.element_at(values, (draw(row_id, seed, slot) % F.size(values) + 1).cast("int"))


def sample(row_id: Column, seed: int, slot: str, values: Sequence[str], size: Column) -> Column:
    """``size`` of the values without replacement, in draw order."""
    keyed = F.transform(
        text_array(list(values)),
        lambda v: F.struct(_digest(row_id, seed, slot + ":", v).alias("d"), v.alias("v")),
    )
    # sort_array compares natively; array_sort would call a lambda for every comparison.
    return F.slice(F.sort_array(keyed)["v"], F.lit(1), size)
