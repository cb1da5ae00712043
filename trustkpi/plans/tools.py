"""The three named tools over canonical rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from trustkpi.operators import charts, kpi
from trustkpi.operators.keyed import Keys


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    input_schema: str
    run: Callable[..., DataFrame]
    defaults: dict = field(default_factory=dict)


# Tool names, descriptions and argument schemas.
TOOLS = {
    tool.name: tool
    for tool in (
        Tool(
            "calculate_kpis",
            "Compute KPIs only from the already-cleaned canonical dataframe.",
            '{"type":"object","properties":{"period":{"type":"string",'
            '"description":"Pandas Grouper frequency, usually D or W.","default":"D"}}}',
            lambda df, keys, period: kpi.kpi_report(df, period, keys),
            {"period": "D"},
        ),
        Tool(
            "generate_chart",
            "Generate a chart from the same cleaned dataframe used for KPI computation.",
            '{"type":"object","properties":{"chart_type":{"type":"string","enum":["line","bar","pie"],'
            '"default":"line"},"x_field":{"type":["string","null"]},"y_field":{"type":"string",'
            '"default":"revenue"},"color_field":{"type":["string","null"]}}}',
            lambda df, keys, chart_type, x_field, y_field, color_field: charts.chart(
                df, chart_type, x_field, y_field, color_field, keys
            ),
            {"chart_type": "line", "x_field": None, "y_field": "revenue", "color_field": None},
        ),
        Tool(
            "generate_chart_set",
            "Generate a small set of recommended charts from the cleaned dataframe.",
            '{"type":"object","properties":{"max_charts":{"type":"integer","minimum":1,"maximum":6,'
            '"default":3}}}',
            lambda df, keys, max_charts: charts.chart_set(df, int(max_charts), keys),
            {"max_charts": 3},
        ),
    )
}


def run_tool(name: str, canonical: DataFrame, arguments: dict | None = None, keys: Keys = ()) -> DataFrame:
    """Run a tool by name; missing arguments take their defaults, others are ignored."""
    if name not in TOOLS:
        raise ValueError(f"Unknown tool: {name}")
    tool = TOOLS[name]
    given = {k: v for k, v in (arguments or {}).items() if k in tool.defaults}
    return tool.run(canonical, keys, **{**tool.defaults, **given})


def tool_table(spark: SparkSession) -> DataFrame:
    """The registry as rows (name, description, input_schema)."""
    rows = [(t.name, t.description, t.input_schema) for t in TOOLS.values()]
    return spark.createDataFrame(rows, "name string, description string, input_schema string")
