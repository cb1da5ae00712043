"""Scoring of model outputs against tool-call records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions.text import strip
from trustkpi.operators.ranking import running_totals
from trustkpi.session import stage

# Arguments stay texts by name, so any JSON value a model writes is kept.
_CALLS = (
    "tool_calls array<struct<method:string,params:struct<name:string,arguments:map<string,string>>>>"
)
# JSON texts that count as "not given".
_EMPTY = ["", "[]", "{}", "0", "0.0", "false"]


def strip_fences(text: Column) -> Column:
    """Text without a leading code fence (with optional ``json``) or a trailing one."""
    bare = strip(text)
    fenced = bare.startswith("```") | bare.endswith("```")
    return F.when(fenced, strip(F.regexp_replace(bare, r"^```(json)?|```$", ""))).otherwise(bare)


def parse_calls(text: Column) -> Column:
    """Calls of a JSON object with ``tool_calls``, NULL for any other text."""
    # As an array's only element the bare text is made once for both readers.
    bare = F.array(strip_fences(text))
    return F.get(F.transform(bare, _json_calls), F.lit(0))


def _json_calls(bare: Column) -> Column:
    return F.when(F.try_parse_json(bare).isNotNull(), F.from_json(bare, _CALLS)["tool_calls"])


def extract_object(text: Column) -> Column:
    """Text from the first opening to the last closing brace if it is JSON, else NULL."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def _given(arguments: Column, name: str) -> Column:
    value = arguments[name]
    return F.coalesce(~value.isin(_EMPTY), F.lit(False))


def is_compliant(calls: Column) -> Column:
    """Every parsed call follows the contract; NULL calls do not."""

    def ok(c: Column) -> Column:
        name, a = c["params"]["name"], c["params"]["arguments"]
        kpi = _given(a, "metrics") & _given(a, "date_column")
        chart = F.coalesce(a["chart_type"].isin(fixed.CHART_TYPES), F.lit(False)) & _given(a, "metric")
        return F.coalesce(
            (c["method"] == fixed.TOOL_METHOD)
            & F.when(name == "calculate_kpis", kpi).when(name == "generate_chart", chart).otherwise(False),
            F.lit(False),
        )

    return F.coalesce(F.forall(calls, ok), F.lit(False))


def output_complies(calls: Column, text: Column) -> Column:
    """Compliant calls, or plain text that never mentions ``tool_calls``."""
    return is_compliant(calls) | (calls.isNull() & ~F.contains(text, F.lit("tool_calls")))


def known_columns(user_text: Column) -> tuple[Column, Column]:
    """Canonical names and raw headers listed in a user message."""
    canonical = F.regexp_extract_all(user_text, F.lit('canonical="([a-zA-Z_]+)"'), 1)
    raw = F.regexp_extract_all(user_text, F.lit('raw_header="([^"]+)"'), 1)
    return F.array_distinct(canonical), F.array_distinct(raw)


def verdict(calls: Column, truth: Column, canonical: Column, raw: Column) -> Column:
    """STRUCT<correct, reasoning_failure> of one output.

    Silence is correct when no call was due. Otherwise the tools must match in
    order and every named column must be known; ``group_by`` is free.
    """
    names = lambda cs: F.transform(cs, lambda c: F.coalesce(c["params"]["name"], F.lit("")))

    def invents(c: Column) -> Column:
        a = c["params"]["arguments"]
        metrics = F.from_json(a["metrics"], "array<string>")
        bad_metrics = a["metrics"].isNotNull() & F.coalesce(
            F.size(F.array_except(metrics, canonical)) > 0, ~a["metrics"].isin(_EMPTY)
        )
        bad_date = _given(a, "date_column") & ~F.array_contains(F.concat(canonical, raw), a["date_column"])
        bad_metric = _given(a, "metric") & ~F.array_contains(canonical, a["metric"])
        return F.coalesce(bad_metrics | bad_date | bad_metric, F.lit(False))

    quiet = (F.size(truth) == 0) & (calls.isNull() | (F.size(calls) == 0))

    def result(correct: bool, failure: bool) -> Column:
        return F.struct(F.lit(correct).alias("correct"), F.lit(failure).alias("reasoning_failure"))

    return (
        F.when(quiet, result(True, False))
        .when(calls.isNull(), result(False, False))
        .when(~names(truth).eqNullSafe(names(calls)), result(False, True))
        .when(F.exists(calls, invents), result(False, True))
        .otherwise(result(True, False))
    )


def score_outputs(rows: DataFrame) -> DataFrame:
    """Add compliant, correct, reasoning_failure.

    ``rows`` has ``output`` (model text) and ``messages`` (chat row whose last
    message is the ground truth).
    """
    parsed = rows.withColumn("_calls", parse_calls(F.col("output"))).withColumn(
        "_truth",
        F.coalesce(
            parse_calls(F.col("messages")[2]["content"]),
            F.from_json(F.lit('{"tool_calls":[]}'), _CALLS)["tool_calls"],
        ),
    )
    canonical, raw = known_columns(F.col("messages")[1]["content"])
    judged = parsed.withColumn("_canonical", canonical).withColumn("_raw", raw)
    judged = judged.withColumn(
        "_verdict", verdict(F.col("_calls"), F.col("_truth"), F.col("_canonical"), F.col("_raw"))
    ).withColumn("compliant", output_complies(F.col("_calls"), F.col("output")))
    return judged.select(*rows.columns, "compliant", "_verdict.correct", "_verdict.reasoning_failure")


def _percent(flag: str) -> Column:
    return F.round(F.avg(F.col(flag).cast("int")) * 100, 1)


def eval_metrics(scored: DataFrame) -> DataFrame:
    """Rates per category, and over all rows where the category is NULL."""
    return scored.rollup("_category").agg(
        F.count(F.lit(1)).alias("n"),
        _percent("compliant").alias("compliance_percent"),
        _percent("correct").alias("correct_percent"),
        _percent("reasoning_failure").alias("reasoning_failure_percent"),
    )


def running_compliance(scored: DataFrame, position: str, every: int = 25) -> DataFrame:
    """Compliance so far at every ``every``-th row in order of ``position``.

    ``position`` is a unique non-negative whole number; it need not be dense.
    """
    # Staged: the totals read these two columns once per level.
    marked = running_totals(
        stage(scored.select(position, "compliant"), "compliance"),
        position,
        {"seen": F.lit(1), "good": F.col("compliant").cast("int")},
    )
    seen = F.col("seen").cast("bigint")
    return marked.where(seen % every == 0).select(
        seen.alias("row_number"), F.round(F.col("good") / F.col("seen") * 100, 1).alias("running_percent")
    )
