"""Raw text rows to trusted canonical rows, for one dataset or many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.operators import quality
from trustkpi.operators.canonical import canonicalize
from trustkpi.operators.clean import clean, present_columns, raw_state
from trustkpi.operators.keyed import Keys, attach, cols
from trustkpi.operators.schema import detect_schema
from trustkpi.session import stage


@dataclass(frozen=True)
class Prepared:
    """``status`` has one row per dataset; ``canonical`` only rows of passed ones."""

    canonical: DataFrame
    status: DataFrame
    quality: DataFrame
    schema: DataFrame
    cleaned: DataFrame


def prepare(
    raw: DataFrame, keys: Keys = (), expected: DataFrame | None = None, order: DataFrame | None = None
) -> Prepared:
    """Clean, score, detect roles, type the rows and decide per dataset.

    ``raw`` holds text columns with clean headers, plus the keys and an
    optional ``_pos``. ``expected`` lists the keys that must get a status row
    even when no usable row arrives. ``order`` (keys, column, pos) gives the places of
    the columns where datasets do not share one header; ties go to the first column.
    """
    state = raw_state(raw, keys)
    cleaned = clean(raw, keys, state)
    present = present_columns(state, keys)
    report = stage(quality.quality_report(cleaned, keys, present), "quality")
    # Datasets that the first gate stops get no roles and no canonical rows.
    going = quality.quality_gate(F.col("duplicate_percent"), F.col("quality_score"))
    sound = attach(cleaned, report.select(*cols(keys), going.alias("_sound")), keys).where("_sound").drop("_sound")
    schema = stage(detect_schema(sound, keys, order), "schema")
    canonical = stage(canonicalize(sound, schema, keys), "canonical")
    critical = quality.missing_critical_fields(canonical, keys)
    status = stage(_status(report, schema, critical, keys), "status")
    if expected is not None and keys:
        status = _with_missing(status, expected, keys)
    passed = status.select(*cols(keys), (F.col("status") == "success").alias("_passed"))
    trusted = attach(canonical, passed, keys).where("_passed").drop("_passed")
    return Prepared(trusted, status, report, schema, cleaned)


def _status(report: DataFrame, schema: DataFrame, critical: DataFrame, keys: Keys) -> DataFrame:
    wide = attach(attach(report, schema, keys), critical, keys)
    empty = F.col("row_count_after_cleaning") == 0
    dup, score, conf = F.col("duplicate_percent"), F.col("quality_score"), F.coalesce("confidence", F.lit(0.0))
    early = ~quality.quality_gate(dup, score)
    low = ~quality.schema_gate(conf)
    incomplete = F.size("missing_critical_fields") > 0
    reason = (
        F.when(empty, fixed.REASON_NO_ROWS)
        .when(early, fixed.REASON_QUALITY)
        .when(low, fixed.REASON_SCHEMA)
        .when(incomplete, fixed.REASON_QUALITY)
    )
    # A dataset stopped before role detection reports its quality score instead.
    seen = F.when(early | empty, F.lit(None).cast("double")).otherwise(conf)
    return wide.select(
        *cols(keys),
        F.when(reason.isNull(), "success").otherwise("failed").alias("status"),
        reason.alias("reason"),
        F.coalesce(seen, score).alias("confidence"),
        quality.warnings(dup, F.col("negative_revenue"), seen).alias("warnings"),
        F.when(
            ~early & ~low & incomplete & ~empty, F.col("missing_critical_fields")
        ).alias("missing_critical_fields"),
        "duplicate_rows", "duplicate_percent", "missing_values", "invalid_numeric", "negative_revenue",
        "quality_score", "row_count_before_cleaning", "row_count_after_cleaning",
    )


def _with_missing(status: DataFrame, expected: DataFrame, keys: Keys) -> DataFrame:
    """Add a failed row for every expected key without any usable row."""
    wanted = expected.select(*cols(keys)).distinct()
    gone = attach(wanted, status.select(*cols(keys), F.lit(True).alias("_seen")), keys).where("_seen IS NULL")
    failed = gone.select(
        *cols(keys), F.lit("failed").alias("status"), F.lit(fixed.REASON_NO_ROWS).alias("reason")
    )
    return status.unionByName(failed, allowMissingColumns=True)
