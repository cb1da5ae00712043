"""Report sentences, sections and answers computed from KPI, chart and quality rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions.text import (
    currency_text,
    fill,
    first_sentences,
    percent_text,
    plain_number,
    quoted_list,
    text_array,
    within_length,
)
from trustkpi.operators.charts import chart_insights
from trustkpi.operators.keyed import Keys, attach, cols
from trustkpi.operators.clean import POSITION
from trustkpi.operators.quality import display_warnings
from trustkpi.operators.requests import usable_texts

_NO_TEXTS = "array<string>"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NO_TEXTS))


def fact_inputs(kpi: DataFrame, charts: DataFrame, status: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row per key with everything the sentences need.

    ``kpi`` is the nested KPI row, ``charts`` the chart set, ``status`` the
    preparation status.
    """
    facts = chart_insights(charts, keys)
    lead = facts.groupBy(*cols(keys)).agg(
        F.min_by("fact", F.when(F.col("fact").isNotNull(), F.col("chart_pos"))).alias("chart_fact"),
        F.max(F.when(F.col("chart_pos") == 1, F.col("chart_id"))).alias("first_chart"),
        F.max(F.when(F.col("chart_pos") == 2, F.col("chart_id"))).alias("second_chart"),
    )
    trust = status.select(*cols(keys), "quality_score", "duplicate_percent", "warnings")
    wide = attach(attach(kpi, lead, keys), trust, keys)
    rate = F.when(
        F.col("duplicate_percent") > 0,
        fill(fixed.DUPLICATE_RATE, percent=plain_number(F.round(F.col("duplicate_percent") * 100, 2))),
    )
    listed = F.array_distinct(F.concat(_or_empty(F.col("warnings")), F.array_compact(F.array(rate))))
    return wide.withColumn("warnings", listed)


def _values(row: DataFrame) -> dict[str, Column]:
    dates = F.col("anomalies.dates")
    return {
        "total": currency_text("total_revenue"),
        "average": currency_text("average_revenue"),
        "growth": percent_text("growth_rate"),
        "rows": F.col("row_count"),
        "latest": F.element_at("series", -1)["date"],
        "count": F.col("anomalies.count"),
        "dates": F.array_join(F.slice(dates, 1, 3), ", "),
        "score": plain_number("quality_score"),
    }


def _actionable(warnings: Column) -> Column:
    return F.get(
        F.filter(warnings, lambda w: (w != "") & ~F.lower(w).contains("dataset quality score")), F.lit(0)
    )


def summary(v: dict[str, Column]) -> Column:
    some = v["count"] > 0
    return F.concat_ws(
        " ",
        fill(fixed.SUMMARY_TOTAL, **v),
        fill(fixed.SUMMARY_LATEST, **v),
        F.when(some, fill(fixed.SUMMARY_ANOMALIES, **v)).otherwise(fixed.SUMMARY_NO_ANOMALIES),
        F.col("chart_fact"),
        F.coalesce(fill(fixed.SUMMARY_QUALITY, **v), F.get("warnings", F.lit(0))),
    )


def insights(v: dict[str, Column]) -> Column:
    some, warning = v["count"] > 0, _actionable(F.col("warnings"))

    def item(title: str, body: Column, tone: Column) -> Column:
        return F.struct(F.lit(title).alias("title"), body.alias("body"), tone.alias("tone"))

    movement = F.concat(
        fill(fixed.INSIGHT_MOVEMENT, **v),
        F.when(some, fill(fixed.INSIGHT_ANOMALIES, **v)).otherwise(fixed.INSIGHT_NO_ANOMALIES),
    )
    positive = F.coalesce(F.col("growth_rate"), F.lit(0.0)) >= 0
    return F.array(
        item("Revenue Baseline", fill(fixed.INSIGHT_BASELINE, **v), F.lit("neutral")),
        item("Recent Movement", movement, F.when(positive, "positive").otherwise("caution")),
        item(
            "Chart Readout",
            F.coalesce(F.col("chart_fact"), F.lit(fixed.INSIGHT_NO_CHART)),
            F.when(F.col("chart_fact").isNotNull(), "neutral").otherwise("caution"),
        ),
        item(
            "Data Quality",
            F.coalesce(warning, fill(fixed.INSIGHT_QUALITY, **v), F.lit(fixed.NO_WARNINGS)),
            F.when(warning.isNotNull(), "caution").otherwise("neutral"),
        ),
    )


def story(v: dict[str, Column]) -> Column:
    some, warning = v["count"] > 0, _actionable(F.col("warnings"))
    second = F.coalesce(F.col("second_chart"), F.col("first_chart"))

    def chapter(name: str, copy: Column, chart: Column) -> Column:
        return F.struct(
            F.lit(f"story-{name}").alias("id"),
            F.lit(name.title()).alias("eyebrow"),
            F.lit(fixed.STORY_HEADLINES[name]).alias("headline"),
            copy.alias("copy"),
            chart.alias("chart_id"),
        )

    overview = F.concat(
        fill(fixed.STORY_OVERVIEW, **v), F.coalesce(F.col("chart_fact"), F.lit(fixed.STORY_NO_CHART))
    )
    trend = F.concat(
        fill(fixed.STORY_TREND, **v),
        F.when(some, fill(fixed.STORY_ANOMALIES, **v)).otherwise(fixed.STORY_NO_ANOMALIES),
    )
    risk = F.coalesce(warning, fill(fixed.STORY_QUALITY, **v), F.lit(fixed.STORY_NO_WARNINGS))
    return F.array(
        chapter("overview", overview, F.col("first_chart")),
        chapter("trend", trend, F.col("first_chart")),
        chapter("risk", risk, second),
    )


def fact_report(inputs: DataFrame, keys: Keys = ()) -> DataFrame:
    """Deterministic report row: title, summary, insights, story, questions, warnings."""
    v = _values(inputs)
    return inputs.select(
        *cols(keys),
        F.lit(fixed.REPORT_TITLE).alias("title"),
        summary(v).alias("summary"),
        insights(v).alias("insights"),
        story(v).alias("story"),
        text_array(fixed.REPORT_QUESTIONS).alias("suggested_questions"),
        "warnings",
    )


def chat_answer() -> Column:
    """Answer text over the columns of a KPI row joined with its quality."""
    base = fill(
        fixed.CHAT_ANSWER,
        total=plain_number("total_revenue"),
        growth=plain_number("growth_rate"),
        average=plain_number("average_revenue"),
        dates=quoted_list(F.col("anomalies.dates")),
    )
    percent = plain_number(F.round(F.col("duplicate_percent") * 100, 2))
    rate = F.when(F.col("duplicate_percent") > 0, fill(fixed.CHAT_DUPLICATES, percent=percent))
    return F.concat(base, F.coalesce(rate, F.lit("")))


def answer_questions(questions: DataFrame, reports: DataFrame) -> DataFrame:
    """Answer every usable question about a stored report.

    ``questions`` has (question_id, report_id, message), ``reports`` has
    report_id, status, the KPI columns and duplicate_percent. Questions without
    a report get no row; see ``rejected_questions`` for texts that cannot be answered.
    """
    asked = questions.where(within_length("message", fixed.MESSAGE_MAX_CHARS))
    joined = asked.join(reports, "report_id")
    failed = F.col("status") == "failed"
    return joined.select(
        "question_id",
        "report_id",
        "message",
        F.when(failed, fixed.GATE_CHAT_ANSWER).otherwise(chat_answer()).alias("answer"),
        F.when(failed, F.array().cast(_NO_TEXTS)).otherwise(text_array(fixed.CHAT_QUESTIONS)).alias("follow_ups"),
    )


def rejected_questions(questions: DataFrame) -> DataFrame:
    """Questions whose message is blank or too long, with ``reject_reason``."""
    return usable_texts(questions, "message", fixed.MESSAGE_MAX_CHARS)[1]


def is_generic(summary_text: Column, story_chapters: Column) -> Column:
    """True when a supplied report text speaks about the tool instead of the data."""
    told = F.array_join(
        F.transform(
            F.coalesce(story_chapters, F.array()),
            lambda c: F.concat_ws(" ", F.coalesce(c["headline"], F.lit("")), F.coalesce(c["copy"], F.lit(""))),
        ),
        " ",
    )
    return _has_marker(F.lower(F.coalesce(summary_text, F.lit("")))) | _has_marker(F.lower(told))


def _has_marker(low: Column) -> Column:
    return F.exists(text_array(fixed.GENERIC_MARKERS), lambda m: F.contains(low, m))


def choose_texts(supplied: DataFrame, facts: DataFrame, keys: Keys, dataset: DataFrame | None = None) -> DataFrame:
    """Supplied report texts where usable, otherwise the deterministic ones.

    Warnings stand in the order dataset (``dataset`` has keys and ``warnings``), supplied, rest.
    """
    own = ["title", "summary", "insights", "story", "suggested_questions", "warnings"]
    base = facts.select(*cols(keys), *[F.col(c).alias(f"_f_{c}") for c in own])
    # Computed before the projection that reuses these names: inside lambdas a
    # name would be taken for the new column of the same projection.
    wide = attach(supplied, base, keys).withColumn("_generic", is_generic(F.col("summary"), F.col("story")))

    def usable(c: str) -> Column:
        if c in ("title", "summary"):
            return F.nullif(F.col(c), F.lit(""))
        return F.when(F.size(c) > 0, F.col(c))

    chosen = []
    for c in own[:-1]:
        value = usable(c)
        if c in ("summary", "insights", "story"):
            value = F.when(~F.col("_generic"), value)
        chosen.append(F.coalesce(value, F.col(f"_f_{c}")).alias(c))
    if dataset is None:
        wide = wide.withColumn("_d_warnings", F.lit(None).cast(_NO_TEXTS))
    else:
        wide = attach(wide, dataset.select(*cols(keys), F.col("warnings").alias("_d_warnings")), keys)
    merged = F.array_distinct(F.concat(*[_or_empty(F.col(c)) for c in ("_d_warnings", "warnings", "_f_warnings")]))
    return wide.select(*cols(keys), *chosen, merged.alias("warnings"))


def sections(report: DataFrame, keys: Keys = ()) -> DataFrame:
    """Four lists of at most three distinct lines, as rows (section, pos, line)."""

    def lines(texts: Column) -> Column:
        kept = F.filter(_or_empty(texts), lambda t: t.isNotNull() & (t != ""))
        return F.slice(F.array_distinct(kept), 1, 3)

    def headline(n: int) -> Column:
        return F.array(F.get("story", F.lit(n))["headline"])

    def titled(i: Column) -> Column:
        lead = F.coalesce(F.get(first_sentences(i["body"]), F.lit(0)), i["body"])
        return F.concat(i["title"], F.lit(": "), lead)

    calm = F.filter("insights", lambda i: ~i["tone"].eqNullSafe(F.lit("caution")))
    tense = F.filter(
        "insights",
        lambda i: i["tone"].eqNullSafe(F.lit("caution"))
        & ~F.lower(F.coalesce(i["body"], F.lit(""))).contains(fixed.HIDDEN_RISK_PART),
    )
    asked = F.transform(
        _or_empty(F.col("suggested_questions")), lambda q: F.regexp_replace(q, r"\?$", "")
    )
    parts = {
        "overview": F.concat(first_sentences("summary", 2), headline(0)),
        "insights": F.transform(calm, titled),
        "risks": F.concat(_or_empty(F.col("warnings")), F.transform(tense, titled)),
        "opportunities": F.concat(headline(1), asked),
    }
    listed = F.array(
        *[F.struct(F.lit(name).alias("section"), lines(texts).alias("lines")) for name, texts in parts.items()]
    )
    grouped = report.select(*cols(keys), F.inline(listed))
    return grouped.select(*cols(keys), "section", F.posexplode("lines").alias("pos", "line")).withColumn(
        "pos", F.col("pos") + 1
    )


def with_defaults(report: DataFrame, keys: Keys = ()) -> DataFrame:
    """Fill missing report parts from status, reason and warnings.

    ``report`` has status, reason, title, summary, insights, story, warnings,
    row_count, row_count_after_cleaning and first_chart.
    """
    failed = F.col("status").eqNullSafe(F.lit("failed"))
    report = report.withColumn("_shown", display_warnings(F.col("warnings")))
    shown = F.col("_shown")
    reason = F.nullif(F.col("reason"), F.lit(""))

    def by_status(gate: Column | str, normal: str) -> Column:
        return F.when(failed, gate).otherwise(F.lit(normal))

    gate_summary = fill(fixed.GATE_SUMMARY, reason=F.coalesce(reason, F.lit(fixed.GATE_SUMMARY_REASON)))
    as_insights = F.transform(
        shown,
        lambda w: F.struct(F.lit("Warning").alias("title"), w.alias("body"), F.lit("caution").alias("tone")),
    )
    chapter = F.struct(
        F.lit("story-quality").alias("id"),
        by_status(fixed.GATE_STORY["eyebrow"], fixed.DEFAULT_STORY["eyebrow"]).alias("eyebrow"),
        by_status(fixed.GATE_STORY["headline"], fixed.DEFAULT_STORY["headline"]).alias("headline"),
        by_status(
            F.coalesce(reason, F.lit(fixed.GATE_STORY["copy"])), fixed.DEFAULT_STORY["copy"]
        ).alias("copy"),
        F.col("first_chart").alias("chart_id"),
    )
    return report.select(
        *cols(keys),
        F.coalesce(F.nullif("title", F.lit("")), by_status(fixed.GATE_TITLE, fixed.DEFAULT_TITLE)).alias("title"),
        F.coalesce(F.nullif("summary", F.lit("")), by_status(gate_summary, fixed.DEFAULT_SUMMARY)).alias("summary"),
        F.coalesce("insights", as_insights).alias("insights"),
        F.coalesce("story", F.array(chapter)).alias("story"),
        F.coalesce("suggested_questions", text_array(fixed.DEFAULT_QUESTIONS)).alias("suggested_questions"),
        shown.alias("warnings"),
        F.coalesce("row_count", "row_count_after_cleaning", F.lit(0)).alias("row_count"),
    )


def panel_questions(given: Column) -> Column:
    """Three fixed questions plus the given ones, distinct, at most six."""
    return F.slice(F.array_distinct(F.concat(text_array(fixed.PANEL_QUESTIONS), _or_empty(given))), 1, 6)


def insight_export(report: DataFrame, keys: Keys = ()) -> DataFrame:
    """Title, summary, insights and story as one JSON text per report."""
    return report.select(
        *cols(keys), F.to_json(F.struct("title", "summary", "insights", "story")).alias("payload")
    )


def dataset_context(schema: DataFrame, status: DataFrame, preview_rows: DataFrame, keys: Keys = ()) -> DataFrame:
    """Schema, preview, quality and warnings of a dataset in one row.

    ``preview_rows`` holds at most the preview limit of rows per key.
    """
    shown = [c for c in preview_rows.columns if c not in keys]
    place = F.col(POSITION) if POSITION in shown else F.lit(0)
    line = F.struct(place.alias("p"), F.to_json(F.struct(*cols([c for c in shown if c != POSITION]))).alias("line"))
    first = preview_rows.groupBy(*cols(keys)).agg(
        F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]).alias("preview")
    )
    roles = schema.select(
        *cols(keys), F.struct(*cols([c for c in schema.columns if c not in keys])).alias("schema")
    )
    trust = status.select(
        *cols(keys),
        F.struct(
            "duplicate_rows", "duplicate_percent", "missing_values", "invalid_numeric", "negative_revenue",
            "quality_score", "row_count_before_cleaning", "row_count_after_cleaning",
        ).alias("quality_report"),
        "warnings",
    )
    return attach(attach(trust, roles, keys), first, keys)


def report_context(report: DataFrame, keys: Keys = ()) -> DataFrame:
    """What a question about a stored report may use."""
    kept = ["summary", "quality_score", "duplicate_percent", "total_revenue", "growth_rate", "average_revenue",
            "anomalies", "insights", "story"]
    return report.select(*cols(keys), F.struct(*kept).alias("context"))
