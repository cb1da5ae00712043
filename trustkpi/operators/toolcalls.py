"""Tool-call records: generate, check, de-duplicate, split, render, convert, blend."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustkpi import fixed
from trustkpi.functions import draws
from trustkpi.functions.text import fill, text_array
from trustkpi.operators.ranking import take_lowest
from trustkpi.session import stage

SEED, SPLIT_SEED, BLEND_SEED = 42, 7, 11

COLUMN_TYPE = "struct<name:string,dtype:string,canonical:string>"
ARGUMENTS_TYPE = (
    "struct<metrics:array<string>,date_column:string,detect_anomalies:boolean,"
    "metric:string,chart_type:string,group_by:string>"
)
CALL_TYPE = f"struct<method:string,params:struct<name:string,arguments:{ARGUMENTS_TYPE}>>"

# Record kinds per ten ids, with difficulty, metric count range
# and the percentage of noisy headers.
KINDS = {
    "clean": {"share": [0, 1], "difficulty": "easy", "metrics": (1, 3), "noisy": 0},
    "noisy": {"share": [2, 3], "difficulty": "medium", "metrics": (1, 3), "noisy": 100},
    "adversarial": {"share": [4, 5], "difficulty": "hard", "metrics": (2, 4), "noisy": 100},
    "chart_only": {"share": [6], "difficulty": "medium", "metrics": (1, 2), "noisy": 40},
    "multi_step": {"share": [7], "difficulty": "hard", "metrics": (2, 3), "noisy": 50},
    "no_tool": {"share": [8, 9], "difficulty": "medium", "metrics": (2, 2), "noisy": 30},
}


def _by_kind(what: dict[str, Column | int | str]) -> Column:
    out = None
    for kind, value in what.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(F.col("category") == kind, value) if out is None else out.when(F.col("category") == kind, value)
    return out


def header_variants() -> Column:
    """Map from metric to its messy headers; metrics without a list get three styles."""
    pairs = []
    for m in fixed.METRIC_NAMES:
        variants = fixed.METRIC_VARIANTS.get(m, [m.upper(), m.title(), f"{m}_$"])
        pairs += [F.lit(m), text_array(variants)]
    return F.create_map(*pairs)


def generate(ids: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """One tool-call record per id, every random choice drawn from the id.

    Output: id, schema, user_query, tool_calls, category, difficulty.
    """
    i = F.col("id")
    slot = F.pmod(i, F.lit(10))
    kind = F.coalesce(*[F.when(slot.isin(k["share"]), name) for name, k in KINDS.items()])
    base = ids.select(F.col(id_col).alias("id")).withColumn("category", kind)
    noisy = draws.draw(i, seed, "noisy") % 100 < _by_kind({k: v["noisy"] for k, v in KINDS.items()})
    low = _by_kind({k: v["metrics"][0] for k, v in KINDS.items()})
    high = _by_kind({k: v["metrics"][1] for k, v in KINDS.items()})
    drawn = base.select(
        "id",
        "category",
        _by_kind({k: v["difficulty"] for k, v in KINDS.items()}).alias("difficulty"),
        noisy.alias("_noisy"),
        draws.between(i, seed, "n_metrics", low, high).alias("_n"),
        draws.choice(i, seed, "date", text_array(fixed.DATE_HEADERS)).alias("_date"),
        draws.choice(i, seed, "group", text_array(fixed.CATEGORY_HEADERS)).alias("_group"),
        draws.between(
            i, seed, "n_noise", 1, F.when(F.col("category") == "adversarial", 3).otherwise(2)
        ).alias("_k"),
        draws.between(i, seed, "n_rows", 30, 500).alias("_rows"),
        F.concat(
            *[
                F.char(F.lit(97) + draws.draw(i, seed, f"letter{n}") % 26)
                for n in range(4)
            ]
        ).alias("_suffix"),
        draws.choice(i, seed, "chart_type", text_array(fixed.CHART_TYPES)).alias("_chart"),
    )
    sampled = drawn.select(
        "*", draws.sample(i, seed, "metric", fixed.METRIC_NAMES, F.col("_n")).alias("_metrics")
    )
    variants = header_variants()
    metric_columns = F.transform(
        "_metrics",
        lambda m: F.struct(
            F.when(
                F.col("_noisy"),
                draws.choice(F.concat_ws("|", i.cast("string"), m), seed, "header", variants[m]),
            ).otherwise(m).alias("name"),
            F.lit("numeric").alias("dtype"),
            m.alias("canonical"),
        ),
    )
    padded = F.when(F.col("_noisy") & draws.chance(i, seed, "pad", 30), "  ").otherwise("")
    date_column = F.struct(
        F.concat("_date", padded).alias("name"), F.lit("date").alias("dtype"), F.lit("date").alias("canonical")
    )
    group_column = F.struct(
        F.col("_group").alias("name"), F.lit("categorical").alias("dtype"), F.lit("category").alias("canonical")
    )
    noise = F.when(F.col("_noisy"), draws.sample(i, seed, "noise", fixed.NOISE_TAGS, F.col("_k"))).otherwise(
        F.array().cast("array<string>")
    )
    schema = F.struct(
        F.concat(F.array(date_column), metric_columns, F.array(group_column)).alias("columns"),
        F.col("_rows").alias("n_rows"),
        noise.alias("noise_applied"),
        F.concat(F.lit("weekly_metrics_"), F.col("_suffix"), F.lit(".csv")).alias("sample_file_name"),
    )
    shaped = sampled.select(
        "id", "category", "difficulty", "_chart", "_metrics", "_group", schema.alias("schema"),
        draws.choice(i, seed, "metric", F.col("_metrics")).alias("_metric"),
    )
    line = F.when(F.col("category") == "multi_step", "line").otherwise(F.col("_chart"))
    kpi, chart = kpi_call(F.col("schema")), chart_call(F.col("schema"), F.col("_metric"), line)
    none = F.array().cast(f"array<{CALL_TYPE}>")
    calls = _by_kind(
        {
            "clean": F.array(kpi), "noisy": F.array(kpi), "adversarial": F.array(kpi),
            "chart_only": F.array(chart), "multi_step": F.array(kpi, chart), "no_tool": none,
        }
    )
    return shaped.select(
        "id", "schema", _query(seed).alias("user_query"), calls.alias("tool_calls"), "category", "difficulty"
    )


def _query(seed: int) -> Column:
    i = F.col("id")
    kpi = draws.choice(i, seed, "template", text_array(fixed.KPI_TEMPLATES))
    chart = draws.choice(i, seed, "template", text_array(fixed.CHART_TEMPLATES))
    template = _by_kind(
        {
            "clean": kpi, "noisy": kpi, "adversarial": kpi, "chart_only": chart,
            "multi_step": F.lit(fixed.MULTI_STEP_QUERY),
            "no_tool": draws.choice(i, seed, "template", text_array(fixed.NO_TOOL_QUERIES)),
        }
    )
    named = {
        "{file}": F.col("schema.sample_file_name"), "{metric}": F.col("_metric"),
        "{chart_type}": F.col("_chart"), "{category}": F.col("_group"),
    }
    for name, value in named.items():
        template = F.replace(template, F.lit(name), value)
    return template


def _call(name: str, **arguments: Column) -> Column:
    call = F.struct(
        F.lit(fixed.TOOL_METHOD).alias("method"),
        F.struct(
            F.lit(name).alias("name"),
            F.struct(
                arguments.get("metrics", F.lit(None).cast("array<string>")).alias("metrics"),
                arguments.get("date_column", F.lit(None).cast("string")).alias("date_column"),
                arguments.get("detect_anomalies", F.lit(None).cast("boolean")).alias("detect_anomalies"),
                arguments.get("metric", F.lit(None).cast("string")).alias("metric"),
                arguments.get("chart_type", F.lit(None).cast("string")).alias("chart_type"),
                arguments.get("group_by", F.lit(None).cast("string")).alias("group_by"),
            ).alias("arguments"),
        ).alias("params"),
    )
    return call.cast(CALL_TYPE)


def _of_type(schema: Column, dtype: str) -> Column:
    return F.filter(schema["columns"], lambda c: c["dtype"] == dtype)


def kpi_call(schema: Column) -> Column:
    """KPI call a schema implies: canonical metrics, raw date header."""
    return _call(
        "calculate_kpis",
        metrics=F.transform(_of_type(schema, "numeric"), lambda c: c["canonical"]),
        date_column=F.get(_of_type(schema, "date"), F.lit(0))["name"],
        detect_anomalies=F.lit(True),
    )


def chart_call(schema: Column, metric: Column, chart_type: Column) -> Column:
    """Chart call: a metric, a chart type, the raw category header or null."""
    return _call(
        "generate_chart",
        metric=metric,
        chart_type=chart_type,
        group_by=F.get(_of_type(schema, "categorical"), F.lit(0))["name"],
    )


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def follows_contract(calls: Column) -> Column:
    """Every call has the method, a known tool and that tool's required arguments."""

    def ok(c: Column) -> Column:
        name, a = c["params"]["name"], c["params"]["arguments"]
        kpi = (F.coalesce(F.size(a["metrics"]), F.lit(0)) > 0) & _given(a["date_column"])
        chart = F.coalesce(a["chart_type"].isin(fixed.CHART_TYPES), F.lit(False)) & _given(a["metric"])
        return F.coalesce(
            (c["method"] == fixed.TOOL_METHOD)
            & F.when(name == "calculate_kpis", kpi).when(name == "generate_chart", chart).otherwise(False),
            F.lit(False),
        )

    return F.forall(calls, ok)


def valid_examples(examples: DataFrame) -> DataFrame:
    return examples.where(follows_contract(F.col("tool_calls")))


def distinct_examples(examples: DataFrame) -> DataFrame:
    """First record (lowest id) per query, category and canonical columns.

    Map-side combined: a query text shared by a third of all records is no hot spot.
    """
    same = [F.col("user_query"), F.col("category"), F.col("schema.columns.canonical").alias("_canonical")]
    kept = examples.groupBy(*same).agg(F.min_by(F.struct(*examples.columns), "id").alias("r"))
    return kept.select("r.*")


def category_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def split(examples: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``split``: 30 % of adversarial records train and the rest test; 10 %
    (at least one) of the others validate and the rest train. Sizes are exact."""
    hard = examples.withColumn("_hard", F.col("category") == "adversarial")

    def wanted(n: Column) -> Column:
        others = F.greatest(F.lit(1), F.floor(n * 0.1))
        return F.when(F.col("_hard"), F.floor(n * 0.3)).otherwise(others)

    marked = take_lowest(hard, ["_hard"], draws.wide_draw(F.col("id"), seed, "split"), "id", wanted, "_low")
    name = (
        F.when(F.col("_hard") & F.col("_low"), "train")
        .when(F.col("_hard"), "adversarial_test")
        .when(F.col("_low"), "val")
        .otherwise("train")
    )
    return marked.withColumn("split", name).drop("_hard", "_low")


def schema_context(schema: Column) -> Column:
    head = fill(
        "Uploaded file: {file} ({rows} rows)", file=schema["sample_file_name"], rows=schema["n_rows"]
    )
    lines = F.transform(
        schema["columns"],
        lambda c: fill(
            '  - raw_header="{name}" -> canonical="{canonical}" (type: {dtype})',
            name=c["name"], canonical=c["canonical"], dtype=c["dtype"],
        ),
    )
    return F.array_join(F.concat(F.array(head, F.lit("Detected columns:")), lines), "\n")


def calls_json(calls: Column) -> Column:
    """Calls as compact JSON; each call holds only its own tool's arguments."""

    def text(c: Column) -> Column:
        a, name = c["params"]["arguments"], c["params"]["name"]
        kpi = F.struct(*[a[f].alias(f) for f in ("metrics", "date_column", "detect_anomalies")])
        chart = F.struct(*[a[f].alias(f) for f in ("metric", "chart_type", "group_by")])

        def whole(arguments: Column) -> Column:
            params = F.struct(name.alias("name"), arguments.alias("arguments"))
            call = F.struct(c["method"].alias("method"), params.alias("params"))
            return F.to_json(call, {"ignoreNullFields": "false"})

        return F.when(name == "generate_chart", whole(chart)).otherwise(whole(kpi))

    return F.concat(F.lit('{"tool_calls":['), F.array_join(F.transform(calls, text), ","), F.lit("]}"))


def assistant_content(calls: Column) -> Column:
    return F.when(F.size(calls) == 0, fixed.NO_TOOL_ANSWER).otherwise(calls_json(calls))


def _messages(system: str, user: Column, assistant: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(system)), message("user", user), message("assistant", assistant)
    )


def chat_rows(examples: DataFrame) -> DataFrame:
    """Three-message rows with category and difficulty tags."""
    user = F.concat(schema_context(F.col("schema")), F.lit("\n\nUser request: "), F.col("user_query"))
    messages = _messages(fixed.TOOL_SYSTEM_PROMPT, user, assistant_content(F.col("tool_calls")))
    extra = [c for c in ("id", "split") if c in examples.columns]
    return examples.select(
        *extra, messages.alias("messages"), F.col("category").alias("_category"),
        F.col("difficulty").alias("_difficulty"),
    )


def compact_calls(calls: list[dict]) -> str:
    """Calls as JSON without blanks: arguments keep their order, the last of repeated names counts, signs beyond
    ASCII are escaped; unreadable arguments become ``{}``."""
    listed = []
    for one in calls:
        try:
            arguments = json.loads(one["arguments"])
        except (TypeError, ValueError, RecursionError):
            arguments = {}
        listed.append({"method": fixed.TOOL_METHOD, "params": {"name": one["name"], "arguments": arguments}})
    return json.dumps({"tool_calls": listed}, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def _compact_calls(calls: pd.Series) -> pd.Series:
    # No built-in function keeps order and repeated names of JSON: Arrow batches, one text per row.
    return calls.map(lambda listed: None if listed is None else compact_calls(list(listed)))


def convert_public(rows: DataFrame) -> DataFrame:
    """Rows of a public function-calling table as chat rows.

    Rows whose tool list is no JSON, or without a user or assistant message,
    are dropped; unreadable arguments become ``{}``.
    """
    tools_type = "array<struct<type:string,function:struct<name:string,description:string>>>"
    by_role = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))
    parsed = rows.select(
        "*", F.from_json("tools", tools_type).alias("_tools"), by_role("user").alias("_user"),
        by_role("assistant").alias("_assistant"),
    ).where("_tools IS NOT NULL AND _user IS NOT NULL AND _assistant IS NOT NULL")
    listed = F.transform(
        "_tools",
        lambda t: F.concat(
            F.lit("- "), F.coalesce(t["function"]["name"], F.lit("None")), F.lit(": "),
            F.coalesce(t["function"]["description"], F.lit("no description")),
        ),
    )
    user = F.concat(
        F.lit("Available tools:\n"), F.array_join(listed, "\n"), F.lit("\n\nUser request: "),
        F.coalesce(F.col("_user.content"), F.lit("None")),
    )

    calls = F.col("_assistant.tool_calls")
    body = _compact_calls(F.transform(calls, lambda c: F.struct(c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments"))))
    assistant = F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, body).otherwise(fixed.PUBLIC_NO_TOOL_ANSWER)
    extra = [c for c in ("id",) if c in rows.columns]
    return parsed.select(
        *extra,
        _messages(fixed.PUBLIC_SYSTEM_PROMPT, user, assistant).alias("messages"),
        F.lit("public_blend").alias("_category"),
        F.lit("medium").alias("_difficulty"),
    )


def blend(train: DataFrame, public: DataFrame, n: int, seed: int = BLEND_SEED) -> DataFrame:
    """Train rows plus up to ``n`` converted public rows, in shuffled order.

    Of the public rows the 3n with the lowest draws are candidates; the first n
    that convert are added. Both selections are exact and distributed.
    """
    order = draws.wide_draw(F.col("id"), seed, "public")
    at_most = lambda k: lambda size: F.least(size, F.lit(k))
    candidates = take_lowest(public, [], order, "id", at_most(3 * n), "_in").where("_in").drop("_in")
    converted = convert_public(candidates).where(F.col("messages")[2]["content"] != "{}")
    chosen = take_lowest(converted, [], order, "id", at_most(n), "_in").where("_in").drop("_in")
    both = train.select("id", "messages", "_category", "_difficulty").unionByName(chosen)
    shuffled = draws.wide_draw(F.concat_ws(":", "_category", F.col("id").cast("string")), seed, "shuffle")
    return both.orderBy(shuffled, "_category", "id")


def training_set(examples: DataFrame, public: DataFrame, share: float = 0.2) -> DataFrame:
    """Chat rows with ``split`` from raw records: valid ones, first of equal ones, split, public rows in train.

    Public rows come to ``share`` of the domain rows in train; validation and test rows stay as they are.
    """
    unique = stage(distinct_examples(valid_examples(examples)), "examples")
    rows = stage(chat_rows(split(unique)), "chat-rows")
    train = rows.where("split = 'train'")
    blended = blend(train, public, int(train.count() * share)).withColumn("split", F.lit("train"))
    return rows.where("split <> 'train'").unionByName(blended)
