"""Tool requests as rows: usable texts, protocol checks, tool log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions.text import strip, within_length

_REQUEST = "jsonrpc string, id string, method string, params struct<name:string,arguments:string>"
LIVE_TOOLS = ["calculate_kpis", "generate_chart", "generate_chart_set"]


def usable_texts(requests: DataFrame, text: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Requests with a usable text, and the rejected ones with the reason."""
    trimmed = strip(F.coalesce(F.col(text), F.lit("")))
    good = requests.where(within_length(text, limit)).withColumn(text, trimmed)
    bad = requests.where(~within_length(text, limit)).withColumn(
        "reject_reason", F.when(F.length(trimmed) == 0, "empty").otherwise("too long")
    )
    return good, bad


def classify(requests: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Add request fields, ``outcome``, ``code`` and ``message`` to JSON payloads.

    ``datasets`` lists known ``dataset_id`` values; a call for any other one has
    no dataset to work on.
    """
    parsed = requests.withColumn("_r", F.from_json("payload", _REQUEST))
    if datasets is None:
        known = parsed.withColumn("_known", F.lit(False))
    else:
        ids = datasets.select("dataset_id").distinct().withColumn("_known", F.lit(True))
        known = parsed.join(ids, "dataset_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    method, tool = F.col("_r.method"), F.col("_r.params.name")
    # The version is a text: the number 2.0 is another value.
    written = F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), "$.jsonrpc", "variant"))
    version = F.coalesce((F.col("_r.jsonrpc") == fixed.REQUEST_VERSION) & (written == "STRING"), F.lit(False))
    is_call = F.coalesce(method == "tools/call", F.lit(False))
    is_other = F.coalesce(method.isin("initialize", "tools/list"), F.lit(False))
    live = F.coalesce(tool.isin(LIVE_TOOLS), F.lit(False))
    shown_method, shown_tool = F.coalesce(method, F.lit("None")), F.coalesce(tool, F.lit("None"))

    def pick(invalid, other, no_data, bad_tool, dispatch, missing) -> Column:
        return (
            F.when(~version, invalid)
            .when(is_other, other)
            .when(is_call & ~F.col("_known"), no_data)
            .when(is_call & ~live, bad_tool)
            .when(is_call, dispatch)
            .otherwise(missing)
        )

    none = F.lit(None).cast("string")
    outcome = pick("error", method, "error", "tool_error", "dispatch", "error")
    code = pick(
        fixed.ERROR_INVALID_REQUEST, None, fixed.ERROR_DATASET_REQUIRED, None, None, fixed.ERROR_METHOD_NOT_FOUND
    )
    message = pick(
        "Invalid Request", none, "Dataset context is required for tools/call",
        F.concat(F.lit("Unknown tool: "), shown_tool), none, F.concat(F.lit("Method not found: "), shown_method),
    )
    return known.select(
        *requests.columns,
        F.col("_r.id").alias("request_id"),
        tool.alias("tool"),
        F.col("_r.params.arguments").alias("arguments"),
        outcome.alias("outcome"),
        code.cast("int").alias("code"),
        message.alias("message"),
    )


def tool_log(calls: DataFrame, report: str = "report_id") -> DataFrame:
    """Log rows (report, seq, entry) with entry STRUCT<name, inputs, output_summary>.

    Rows stay in long form; ``seq`` orders them within a report.
    """
    inputs = F.from_json(F.coalesce("arguments", F.lit("{}")), "map<string,string>")
    return calls.select(
        report,
        "seq",
        F.struct(F.col("tool").alias("name"), inputs.alias("inputs"), F.col("output_summary")).alias("entry"),
    )
