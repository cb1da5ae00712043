"""Cleaning and exact de-duplication of raw text tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions import numbers, text
from trustkpi.operators.column_state import column_state, exact_limit, long_rows, with_distinct
from trustkpi.operators.keyed import Keys, attach, cols, data_columns
from trustkpi.session import stage

POSITION = "_pos"
COPIES = "_copies"


def unique_headers(names: Sequence[str]) -> list[str]:
    """Clean headers; a repeated name gets the first free ``_1``, ``_2`` …"""
    out: list[str] = []
    wanted = [text.clean_header(n) for n in names]
    taken: set[str] = set()
    for name in wanted:
        candidate, k = name, 0
        while candidate in taken or (k and candidate in wanted):
            k += 1
            candidate = f"{name}_{k}"
        taken.add(candidate)
        out.append(candidate)
    return out


def normalize_headers(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rename data columns to clean unique headers; ``keep`` names stay as they are."""
    fresh = iter(unique_headers([c for c in df.columns if c not in keep]))
    return df.toDF(*[c if c in keep else next(fresh) for c in df.columns])


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns that are NULL in every row (reads one row of counts)."""
    names = [c for c in df.columns if c not in keep]
    counts = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(cols(names))]).first()
    empty = {n for i, n in enumerate(names) if counts[i] == 0}
    return df.select(*cols([c for c in df.columns if c not in empty]))


def drop_empty_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(F.coalesce(*[F.col(f"`{c}`").isNotNull() | F.lit(None) for c in columns], F.lit(False)))


def most_labels(non_null: Column) -> Column:
    return F.greatest(F.lit(fixed.LOW_CARDINALITY_FLOOR), F.floor(non_null * F.lit(fixed.LOW_CARDINALITY_RATIO)))


def is_low_cardinality(distinct: Column, non_null: Column) -> Column:
    return distinct.between(2, most_labels(non_null))


def _cells(raw: DataFrame, keys: Keys, columns: Sequence[str]) -> DataFrame:
    cells = long_rows(raw, keys, columns).withColumn("held", F.col("value").isNotNull())
    return cells.withColumn("value", text.normalize_text("value"))


def raw_state(raw: DataFrame, keys: Keys = ()) -> DataFrame:
    """What one pass over the raw rows tells of each column: see ``column_state``.

    ``integer``, ``number`` and ``boolean`` tell that no value is anything else, ``held`` that there is
    a raw value; a blank is one, NULL is not. ``distinct`` is exact wherever it can decide between label and text.
    """
    cells = _cells(raw, keys, data_columns(raw, keys, POSITION))
    state = column_state(
        cells, keys,
        [
            F.bool_and(numbers.looks_integer("value")).alias("integer"),
            F.bool_and(numbers.looks_number("value")).alias("number"),
            F.bool_and(numbers.looks_boolean("value")).alias("boolean"),
            F.bool_or("held").alias("held"),
        ],
    )
    wordy = ~F.col("integer") & ~F.col("number") & ~F.col("boolean")
    # More values than a sketch can count are too many for labels, unless the column may have as many labels.
    return with_distinct(
        state, lambda names: _cells(raw, keys, names), keys,
        wordy & (most_labels(F.col("non_null")) >= exact_limit()),
    )


def column_rules(state: DataFrame, keys: Keys = ()) -> DataFrame:
    """How each column is standardised, from ``raw_state``: (keys, rules MAP<column, rule>).

    ``integer``, ``number`` and ``boolean`` columns hold nothing else; other
    columns are ``label`` when they have few distinct values, else ``text``.
    """
    rule = (
        F.when(F.col("integer"), "integer")
        .when(F.col("number"), "number")
        .when(F.col("boolean"), "boolean")
        .when(is_low_cardinality(F.col("distinct"), F.col("non_null")), "label")
        .otherwise("text")
    )
    # One entry per column of the table.
    return state.where("non_null > 0").groupBy(*cols(keys)).agg(
        F.map_from_entries(F.collect_list(F.struct("column", rule.alias("rule")))).alias("rules")
    )


def standardize(raw: DataFrame, keys: Keys = (), state: DataFrame | None = None) -> DataFrame:
    """Text normalised, labels title-cased, equal numbers spelled equally; ``state`` as ``raw_state`` gives it."""
    columns = data_columns(raw, keys, POSITION)
    rules = stage(column_rules(raw_state(raw, keys) if state is None else state, keys), "rules")
    ruled = attach(raw, rules, keys)
    # Rule and tidy text of each cell first, so that the choice between the rules repeats neither.
    ruled = ruled.select(
        *cols([*keys, *_position(raw)]), *[text.normalize_text(F.col(f"`{c}`")).alias(f"_plain{i}") for i, c in enumerate(columns)],
        *[F.col("rules")[c].alias(f"_rule{i}") for i, c in enumerate(columns)],
    )
    out = []
    for i, c in enumerate(columns):
        plain, rule = F.col(f"_plain{i}"), F.col(f"_rule{i}")
        value = (
            F.when(rule == "text", plain)
            .when(rule == "label", text.title_case(plain))
            .when(rule == "integer", numbers.integer_text(plain))
            .when(rule == "number", F.regexp_replace(plain.try_cast("double").cast("string"), r"\.0$", ""))
            .when(rule == "boolean", F.initcap(plain))
        )
        out.append(value.alias(c))
    return ruled.select(*cols([*keys, *_position(raw)]), *out)


def _position(df: DataFrame) -> list[str]:
    return [POSITION] if POSITION in df.columns else []


def drop_duplicates(standard: DataFrame, keys: Keys = ()) -> DataFrame:
    """Distinct rows with their number of copies and first position.

    One shuffle gives both the duplicate count and the kept rows; copies are
    combined before it, so a row repeated a billion times is no hot spot.
    """
    columns = data_columns(standard, keys, POSITION)
    first = [F.min(POSITION).alias(POSITION)] if POSITION in standard.columns else []
    return standard.groupBy(*cols(keys), *cols(columns)).agg(
        *first, F.count(F.lit(1)).alias(COPIES)
    )


def present_columns(state: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, present ARRAY<column>): columns with any raw value, from ``raw_state``."""
    return state.groupBy(*cols(keys)).agg(F.collect_list(F.when(F.col("held"), F.col("column"))).alias("present"))


def clean(raw: DataFrame, keys: Keys = (), state: DataFrame | None = None) -> DataFrame:
    """Raw text rows to distinct standardised rows (plus ``_copies``, ``_pos``).

    Staged: quality, profile, role scoring and canonical rows all read it. ``state`` is
    ``raw_state`` of the same rows, if it is known already.
    """
    columns = data_columns(raw, keys, POSITION)
    rows = drop_empty_rows(raw, columns)
    return stage(drop_duplicates(standardize(rows, keys, state), keys), "clean")


def duplicate_summary(cleaned: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, before, after, duplicate_rows, duplicate_percent)."""
    before, after = F.sum(COPIES), F.count(F.lit(1))
    return cleaned.groupBy(*cols(keys)).agg(
        F.coalesce(before, F.lit(0)).alias("row_count_before_cleaning"),
        after.alias("row_count_after_cleaning"),
        F.coalesce(before - after, F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.round((before - after) / F.greatest(before, F.lit(1)), 4), F.lit(0.0)).alias(
            "duplicate_percent"
        ),
    )
