"""Canonical rows: typed role columns beside the clean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi.functions.dates import parse_date
from trustkpi.functions.numbers import parse_number
from trustkpi.functions.text import normalize_label
from trustkpi.operators.clean import COPIES, POSITION
from trustkpi.operators.keyed import Keys, attach, cols, data_columns
from trustkpi.operators.schema import ROLES, pick

# How the text of each role becomes its typed column.
READ_ROLE = {
    "date": parse_date,
    "revenue": parse_number,
    "category": normalize_label,
    "region": normalize_label,
    "price": parse_number,
    "quantity": parse_number,
}


def typed(role: str, value: Column) -> Column:
    return READ_ROLE[role](value)


def canonicalize(cleaned: DataFrame, schema: DataFrame, keys: Keys = ()) -> DataFrame:
    """Clean columns plus date, revenue, category, region, price, quantity.

    A role column replaces a source column of the same name. Roles that were
    not detected read that source column, or are NULL.
    """
    columns = data_columns(cleaned, keys, POSITION, COPIES)
    roles = schema.select(*cols(keys), *[f"{r}_col" for r in ROLES])
    rows = attach(cleaned, roles, keys)
    sources = []
    for role in ROLES:
        own = F.col(f"`{role}`") if role in columns else F.lit(None).cast("string")
        source = F.when(F.col(f"{role}_col").isNull(), own).otherwise(
            pick(rows, F.col(f"{role}_col"), columns)
        )
        sources.append(source.alias(f"_{role}"))
    position = [c for c in (POSITION,) if c in cleaned.columns]
    kept = [*keys, *position, *[c for c in columns if c not in ROLES]]
    # Two projections: the source text is chosen once, then parsed.
    return rows.select(*cols(kept), *sources).select(
        *cols(kept), *[typed(role, F.col(f"_{role}")).alias(role) for role in ROLES]
    )
