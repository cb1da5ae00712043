"""Raw rows to stored-report rows in one flow, for one dataset or many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustkpi.operators import charts, facts, kpi
from trustkpi.operators.keyed import Keys, attach, cols
from trustkpi.plans.prepare import Prepared, prepare
from trustkpi.session import stage


@dataclass(frozen=True)
class Analysis:
    prepared: Prepared
    kpis: DataFrame
    charts: DataFrame
    report: DataFrame


def analyze(
    raw: DataFrame, keys: Keys = (), freq: str = "D", max_charts: int = 3, expected: DataFrame | None = None
) -> Analysis:
    """Prepare, then KPIs, chart set and report texts for the datasets that passed.

    ``expected`` lists keys that must be reported even when no usable row arrives.
    """
    prepared = prepare(raw, keys, expected)
    numbers = stage(kpi.kpi_report(prepared.canonical, freq, keys), "kpis")
    drawn = stage(charts.chart_set(prepared.canonical, max_charts, keys), "charts")
    inputs = facts.fact_inputs(numbers, drawn, prepared.status, keys)
    return Analysis(prepared, numbers, drawn, facts.fact_report(inputs, keys))


def report_rows(analysis: Analysis, keys: Keys = ()) -> DataFrame:
    """One wide row per dataset: status, quality, schema, KPIs and texts; gaps filled."""
    status, schema = analysis.prepared.status, analysis.prepared.schema
    wide = attach(status, schema.drop("confidence"), keys)
    wide = attach(wide, analysis.kpis.drop("series"), keys)
    texts = analysis.report.select(
        *cols(keys),
        *[
            F.col(c).alias(f"_t_{c}")
            for c in ("title", "summary", "insights", "story", "suggested_questions", "warnings")
        ],
    )
    wide = attach(wide, texts, keys)
    named = wide.withColumns(
        {
            "title": F.col("_t_title"),
            "summary": F.col("_t_summary"),
            "insights": F.col("_t_insights"),
            "story": F.col("_t_story"),
            "suggested_questions": F.col("_t_suggested_questions"),
            "warnings": F.coalesce("_t_warnings", "warnings"),
            "first_chart": F.when(F.col("status") == "success", "revenue-trend"),
        }
    )
    shown = facts.with_defaults(named, keys)
    rest = named.select(
        *cols(keys), "status", "reason", "confidence", "quality_score", "duplicate_percent",
        "date_col", "revenue_col", "category_col", "region_col", "total_revenue", "growth_rate",
        "average_revenue", "anomalies", "period_count",
    )
    return attach(rest, shown, keys)
