"""Quality counts, score, gates, warnings and display bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions.numbers import parse_number
from trustkpi.functions.text import clean_header
from trustkpi.operators.clean import COPIES, POSITION, duplicate_summary
from trustkpi.operators.keyed import Keys, attach, cols, data_columns


def has_hint(name: str, hints: list[str]) -> bool:
    return bool(set(clean_header(name).split()) & set(hints))


def column_quality(cleaned: DataFrame, keys: Keys = (), present: DataFrame | None = None) -> DataFrame:
    """Counts per column: (keys, column, rows, missing, numeric, invalid, negative, candidate).

    One aggregate over the rows computes every column's counters; only a row
    per key leaves the map side. Columns without any value are left out; ``present``
    (see ``clean.present_columns``) tells those from columns that held blanks only, which count.
    """
    columns = data_columns(cleaned, keys, POSITION, COPIES)
    counters = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`")
        number = parse_number(value)
        counters += [F.count(value).alias(f"_nn{i}"), F.count(number).alias(f"_ok{i}")]
        if has_hint(c, fixed.REVENUE_LIKE_HINTS):
            counters.append(F.count_if(number < 0).alias(f"_neg{i}"))
    wide = cleaned.groupBy(*cols(keys)).agg(*counters)
    rows = F.col("_rows")
    entries = []
    for i, c in enumerate(columns):
        ok, filled = F.col(f"_ok{i}"), F.col(f"_nn{i}")
        hinted = has_hint(c, fixed.NUMERIC_HINTS)
        candidate = F.lit(hinted) | (ok / F.greatest(rows, F.lit(1)) >= fixed.NUMERIC_CANDIDATE_RATIO)
        negative = F.col(f"_neg{i}") if has_hint(c, fixed.REVENUE_LIKE_HINTS) else F.lit(0).cast("bigint")
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                rows.alias("rows"),
                (rows - filled).alias("missing"),
                ok.alias("numeric"),
                F.when(candidate, filled - ok).alias("invalid"),
                negative.alias("negative"),
                candidate.alias("candidate"),
            )
        )
    listed = wide.select(*cols(keys), F.inline(F.array(*entries)))
    if present is None:
        return listed.where("missing < rows")
    return attach(listed, present, keys).where(F.array_contains("present", F.col("column"))).drop("present")


def quality_score(
    rows: Column, duplicate_percent: Column, missing: Column, invalid: Column, negative: Column
) -> Column:
    n = F.greatest(rows, F.lit(1))
    penalty = (
        F.least(F.lit(0.35), duplicate_percent * 1.5)
        + F.least(F.lit(0.25), missing / n * 0.8)
        + F.least(F.lit(0.25), invalid / n)
        + F.least(F.lit(0.15), negative / n)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty)), 4)


def quality_report(cleaned: DataFrame, keys: Keys = (), present: DataFrame | None = None) -> DataFrame:
    """One row per key: counts, maps by column, score."""
    by_column = column_quality(cleaned, keys, present)
    # One entry per column of the table.
    merged = by_column.groupBy(*cols(keys)).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "missing"))).alias("missing_values"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("candidate"), F.struct("column", "invalid")))
        ).alias("invalid_numeric"),
        F.sum("missing").alias("_missing"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("_invalid"),
        F.sum("negative").alias("negative_revenue"),
    )
    wide = attach(duplicate_summary(cleaned, keys), merged, keys)
    score = quality_score(
        F.col("row_count_after_cleaning"), F.col("duplicate_percent"),
        F.col("_missing"), F.col("_invalid"), F.col("negative_revenue"),
    )
    return wide.select(
        *cols(keys), "duplicate_rows", "duplicate_percent", "missing_values", "invalid_numeric",
        "negative_revenue", score.alias("quality_score"),
        "row_count_before_cleaning", "row_count_after_cleaning",
    )


def quality_gate(duplicate_percent: Column, score: Column) -> Column:
    """True when the data may be analysed."""
    return (duplicate_percent <= fixed.DUPLICATE_PERCENT_MAX) & (score >= fixed.QUALITY_SCORE_MIN)


def schema_gate(confidence: Column) -> Column:
    return confidence >= fixed.SCHEMA_CONFIDENCE_MIN


def warnings(duplicate_percent: Column, negative_revenue: Column, confidence: Column) -> Column:
    """Warning texts in fixed order; a dataset without schema has confidence 0."""
    return F.array_compact(
        F.array(
            F.when(duplicate_percent > 0.1, fixed.WARN_DUPLICATES_HIGH).when(
                duplicate_percent > 0, fixed.WARN_DUPLICATES
            ),
            F.when(negative_revenue > 0, fixed.WARN_NEGATIVE),
            F.when(F.coalesce(confidence, F.lit(0.0)) < fixed.LOW_CONFIDENCE_WARNING, fixed.WARN_LOW_CONFIDENCE),
        )
    )


def missing_critical_fields(canonical: DataFrame, keys: Keys = ()) -> DataFrame:
    """Fields among date and revenue that are absent or NULL in any row, per key."""
    flags = []
    for field in ("date", "revenue"):
        bad = F.count_if(F.col(field).isNull()) > 0 if field in canonical.columns else F.lit(True)
        flags.append(F.when(bad, field))
    return canonical.groupBy(*cols(keys)).agg(
        F.array_compact(F.array(*flags)).alias("missing_critical_fields")
    )


def quality_band(score: Column, warning_count: Column) -> Column:
    score = F.coalesce(score, F.lit(1.0))
    return (
        F.when((warning_count > 0) & (score < 0.8), "risk")
        .when((warning_count > 0) | (score < 0.95), "warn")
        .otherwise("good")
    )


def confidence_label(value: Column) -> Column:
    return (
        F.when(value >= 0.9, "High").when(value >= 0.8, "Good").when(value >= 0.65, "Moderate").otherwise("Low")
    )


def display_warnings(texts: Column) -> Column:
    """Without blank texts and texts meant for operators only."""

    def shown(w: Column) -> Column:
        low = F.lower(F.coalesce(w, F.lit("")))
        keep = low != ""
        for part in fixed.HIDDEN_WARNING_PARTS:
            keep = keep & ~low.contains(part)
        return keep

    return F.filter(F.coalesce(texts, F.array().cast("array<string>")), shown)


def whole_percent(value: Column) -> Column:
    scaled = F.floor(F.coalesce(value, F.lit(0.0)) * 100 + 0.5).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), scaled))
