"""Executes classified tool requests: one keyed plan per distinct tool and arguments, results fanned back."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi.operators import charts
from trustkpi.operators.keyed import attach, cols
from trustkpi.plans.tools import TOOLS, run_tool
from trustkpi.session import stage

# Distinct (tool, arguments) pairs of one call; each is a plan of its own.
MOST_GROUPS = 2_000
# Plans that are run together.
TOGETHER = 16
NO_ROWS = "The dataset has no rows with a date and a revenue."


def known_arguments(tool: Column, arguments: Column) -> Column:
    """The arguments a tool knows, as JSON in a fixed order; anything else is ignored, null means not given."""
    picked = F.lit("{}")
    for name, one in TOOLS.items():
        fields = [F.get_json_object(arguments, f"$.{a}").alias(a) for a in sorted(one.defaults)]
        picked = F.when(tool == name, F.to_json(F.struct(*fields))).otherwise(picked)
    return picked


def _whole(value: str) -> int:
    return max(0, int(float(value)))


def _typed(tool: str, arguments: dict) -> dict:
    """Arguments as the tool takes them; ValueError if one can't be."""
    if "max_charts" in arguments:
        try:
            arguments = {**arguments, "max_charts": _whole(arguments["max_charts"])}
        except (ValueError, OverflowError):
            raise ValueError(f"max_charts is no whole number: {arguments['max_charts']}") from None
    return arguments


def _chart_rows(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chart_pos, chart): points of each chart as one struct; the calendar and the top ten bound them."""
    place = F.col("chart_pos") if "chart_pos" in points.columns else F.lit(1)
    listed = F.sort_array(F.collect_list(F.struct("pos", "x", F.col("y").cast("double").alias("y"))))
    return points.groupBy(*cols(keys), place.alias("chart_pos"), F.col("chart_id").alias("id"), "type", "title").agg(
        F.transform(listed, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("data_points")
    ).select(*cols(keys), "chart_pos", F.struct("id", "type", "title", "data_points").alias("chart"))


def tool_results(tool: str, canonical: DataFrame, arguments: dict, keys: list[str]) -> DataFrame:
    """(keys, result): a tool's answer as JSON, one row per dataset that has rows."""
    arguments = _typed(tool, arguments)
    made = run_tool(tool, canonical, arguments, keys)
    if tool == "calculate_kpis":
        names = [c for c in made.columns if c not in keys]
        return made.select(*cols(keys), F.to_json(F.struct(*names)).alias("result"))
    drawn = _chart_rows(made, keys)
    if tool == "generate_chart":
        return drawn.select(*cols(keys), F.to_json("chart").alias("result"))
    most = arguments.get("max_charts", TOOLS[tool].defaults["max_charts"])
    sets = drawn.where(F.col("chart_pos") <= most).groupBy(*cols(keys)).agg(
        F.sort_array(F.collect_list(F.struct("chart_pos", "chart")))["chart"].alias("charts")
    )
    specs = charts.chart_specs(canonical, most, keys).groupBy(*cols(keys)).agg(
        F.sort_array(F.collect_list(F.struct("pos", "chart_type", "x_field", "y_field"))).alias("_specs")
    )
    plain = F.transform("_specs", lambda s: F.struct(*[s[f].alias(f) for f in ("chart_type", "x_field", "y_field")]))
    none = F.array().cast("array<struct<chart_type:string,x_field:string,y_field:string>>")
    return attach(sets, specs, keys).select(
        *cols(keys), F.to_json(F.struct("charts", F.coalesce(plain, none).alias("recommendations"))).alias("result")
    )


def dispatch(
    requests: DataFrame, canonical: DataFrame, key: str = "dataset_id", read: Callable[[Column], dict[str, Column]] | None = None
) -> DataFrame:
    """``requests`` (as ``classify`` gives them) with ``is_error`` and ``result``; errors also get a ``message``.

    Dispatched requests are grouped by tool and known arguments. Each group is one keyed plan over the rows of
    the datasets it asks for, whatever the number of its requests, and its results are joined
    back. Arguments a tool refuses, and datasets without usable rows, are errors of their requests alone.
    ``read`` gives columns taken from a result's JSON; each result is read once, not once per request that gets it.
    """
    going = F.col("outcome") == "dispatch"
    rows = requests.withColumn("_args", F.when(going, known_arguments(F.col("tool"), F.col("arguments"))))
    rows = stage(rows, "requests")
    asked = stage(rows.where(going).select(key, "tool", "_args").distinct(), "asked")
    groups = asked.select("tool", "_args").distinct().orderBy("tool", "_args").limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} different calls at once; dispatch them in parts")
    kind = dict(canonical.dtypes).get(key)
    if kind is None:
        raise ValueError(f"canonical rows have no column {key}")
    done, refused = [], []
    for tool, text in groups:
        mine = (F.col("tool") == tool) & (F.col("_args") == text)
        wanted = asked.where(mine).select(F.col(key).alias("_wanted"))
        own = canonical.join(wanted, canonical[f"`{key}`"] == wanted["_wanted"], "left_semi")
        try:
            found = tool_results(tool, own, json.loads(text), [key])
        except ValueError as error:
            refused.append((tool, text, str(error)))
            continue
        done.append(found.select(F.col(key), F.lit(tool).alias("tool"), F.lit(text).alias("_args"), "result"))
    spark = requests.sparkSession
    none = spark.createDataFrame([], f"`{key}` {kind}, tool string, _args string, result string")
    parts = [reduce(DataFrame.unionByName, done[at : at + TOGETHER]) for at in range(0, len(done), TOGETHER)] or [none]
    results = [stage(p, "results") for p in parts]
    taken = read(F.col("result")) if read else {}
    if taken:
        results = [stage(r.withColumns(taken), "read") for r in results]
    # Whether there is a result is told apart from its text, which only those who ask for it need.
    results = [r.withColumn("_held", F.col("result").isNotNull()) for r in results]
    reasons = spark.createDataFrame(refused, "tool string, _args string, _reason string")
    joined = attach(rows, reduce(DataFrame.unionByName, results), [key, "tool", "_args"])
    joined = attach(joined, reasons, ["tool", "_args"])
    reason = F.when(F.col("outcome") == "dispatch", F.coalesce("_reason", F.when(~F.coalesce("_held", F.lit(False)), NO_ROWS)))
    failed = F.col("outcome").isin("error", "tool_error") | reason.isNotNull()
    kept = [c for c in requests.columns if c not in ("message", "result", "is_error")]
    return joined.select(
        *cols(kept), F.coalesce(reason, F.col("message")).alias("message"), failed.alias("is_error"),
        F.when(reason.isNull(), F.col("result")).alias("result"),
        *[F.when(reason.isNull(), F.col(f"`{c}`")).alias(c) for c in taken],
    )
