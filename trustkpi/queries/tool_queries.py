"""Tool-call record, scoring and request queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.operators import evals, requests
from trustkpi.operators import toolcalls as tc
from trustkpi.plans.dispatch import dispatch
from trustkpi.queries import inputs as src
from trustkpi.queries.fact_queries import lit
from trustkpi.session import stage


def _listed(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def _draw(slot: str, seed: int = 42, row: str = "cast(id AS varchar)", width: int = 8) -> str:
    return f"cast('0x' || substr(md5({row} || '|{seed}|{slot}'), 1, {width}) AS bigint)"


def _choice(slot: str, values: str) -> str:
    return f"({values})[1 + {_draw(slot)} % len({values})]"


def _sample(slot: str, values, size: str) -> str:
    return (
        f"list_transform((list_sort(list_transform({_listed(values)}, lambda word: "
        f"{{'d': md5(cast(id AS varchar) || '|42|{slot}:' || word), 'v': word}})))[1:{size}], lambda s: s.v)"
    )


def _by_kind(values: dict) -> str:
    return "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_VARIANTS = (
    "map(" + _listed(fixed.METRIC_NAMES) + ", ["
    + ", ".join(
        _listed(fixed.METRIC_VARIANTS.get(m, [m.upper(), m.title(), f"{m}_$"])) for m in fixed.METRIC_NAMES
    )
    + "])"
)
_KIND = "CASE " + " ".join(
    f"WHEN id % 10 IN ({', '.join(map(str, k['share']))}) THEN '{name}'" for name, k in tc.KINDS.items()
) + " END"
_KPI_TEXT = _choice("template", _listed(fixed.KPI_TEMPLATES))
_TEMPLATE = _by_kind(
    {
        "clean": _KPI_TEXT, "noisy": _KPI_TEXT, "adversarial": _KPI_TEXT,
        "chart_only": _choice("template", _listed(fixed.CHART_TEMPLATES)),
        "multi_step": lit(fixed.MULTI_STEP_QUERY),
        "no_tool": _choice("template", _listed(fixed.NO_TOOL_QUERIES)),
    }
)
_LETTERS = " || ".join(f"chr(cast(97 + {_draw(f'letter{n}')} % 26 AS integer))" for n in range(4))
_KPI_JSON = (
    "'{\"method\":\"tools/call\",\"params\":{\"name\":\"calculate_kpis\",\"arguments\":{\"metrics\":[\"' || "
    "array_to_string(metrics, '\",\"') || '\"],\"date_column\":\"' || headers[1] || '\",\"detect_anomalies\":true}}}'"
)
_CHART_JSON = (
    "'{\"method\":\"tools/call\",\"params\":{\"name\":\"generate_chart\",\"arguments\":{\"metric\":\"' || metric || "
    "'\",\"chart_type\":\"' || ctype || '\",\"group_by\":\"' || grp || '\"}}}'"
)
EXAMPLE_CTES = f"""
ids AS (SELECT event_id AS id, {_KIND.replace('id %', 'event_id %')} AS category FROM events),
d AS (SELECT *, {_by_kind({k: lit(v['difficulty']) for k, v in tc.KINDS.items()})} AS difficulty,
  {_draw('noisy')} % 100 < {_by_kind({k: v['noisy'] for k, v in tc.KINDS.items()})} AS isnoisy,
  {_by_kind({k: f"{v['metrics'][0]} + {_draw('n_metrics')} % {v['metrics'][1] - v['metrics'][0] + 1}"
             for k, v in tc.KINDS.items()})} AS nm,
  {_choice('date', _listed(fixed.DATE_HEADERS))} AS dateh, {_choice('group', _listed(fixed.CATEGORY_HEADERS))} AS grp,
  1 + {_draw('n_noise')} % (CASE WHEN category = 'adversarial' THEN 3 ELSE 2 END) AS kn,
  cast(30 + {_draw('n_rows')} % 471 AS integer) AS n_rows, 'weekly_metrics_' || {_LETTERS} || '.csv' AS file,
  {_choice('chart_type', _listed(fixed.CHART_TYPES))} AS chart FROM ids),
m AS (SELECT *, {_sample('metric', fixed.METRIC_NAMES, 'nm')} AS metrics FROM d),
h AS (SELECT *, {_choice('metric', 'metrics')} AS metric,
  CASE category WHEN 'multi_step' THEN 'line' ELSE chart END AS ctype,
  list_concat(list_concat([dateh || CASE WHEN isnoisy AND {_draw('pad')} % 100 < 30 THEN '  ' ELSE '' END],
    list_transform(metrics, lambda x: CASE WHEN isnoisy THEN {_VARIANTS}[x][1 +
      cast('0x' || substr(md5(cast(id AS varchar) || '|' || x || '|42|header'), 1, 8) AS bigint)
      % len({_VARIANTS}[x])] ELSE x END)), [grp]) AS headers,
  list_concat(list_concat(['date'], metrics), ['category']) AS canonical,
  list_concat(list_concat(['date'], list_transform(metrics, lambda x: 'numeric')), ['categorical']) AS dtypes,
  CASE WHEN isnoisy THEN {_sample('noise', fixed.NOISE_TAGS, 'kn')} ELSE [] END AS noise FROM m),
ex AS (SELECT *, replace(replace(replace(replace({_TEMPLATE}, '{{file}}', file), '{{metric}}', metric),
    '{{chart_type}}', chart), '{{category}}', grp) AS user_query,
  CASE category WHEN 'chart_only' THEN [{_CHART_JSON}] WHEN 'multi_step' THEN [{_KPI_JSON}, {_CHART_JSON}]
    WHEN 'no_tool' THEN [] ELSE [{_KPI_JSON}] END AS calls FROM h),
shown AS (SELECT *, 'Uploaded file: ' || file || ' (' || n_rows || ' rows)' || E'\\nDetected columns:\\n' ||
    array_to_string(list_transform(range(1, len(headers) + 1), lambda i: '  - raw_header="' || headers[i]
      || '" -> canonical="' || canonical[i] || '" (type: ' || dtypes[i] || ')'), E'\\n') AS context,
  CASE WHEN len(calls) = 0 THEN {lit(fixed.NO_TOOL_ANSWER)}
    ELSE '{{"tool_calls":[' || array_to_string(calls, ',') || ']}}' END AS answer FROM ex),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_query, category, canonical ORDER BY id) AS rn
  FROM shown) WHERE rn = 1)"""


def _examples(spark, folder):
    # Only ids are shuffled; the long expressions built from them then run in all tasks.
    return tc.generate(src.dealt(src.table(spark, folder, "events").select("event_id"), "event_id"), "event_id")


def generate(spark, folder):
    return _examples(spark, folder).select(
        "id", "category", "difficulty", "user_query",
        F.array_join("schema.columns.name", "|").alias("headers"),
        F.array_join("schema.columns.canonical", "|").alias("canonical"),
        F.array_join("schema.columns.dtype", "|").alias("dtypes"),
        F.array_join("schema.noise_applied", "|").alias("noise"),
        F.col("schema.n_rows").alias("n_rows"), F.col("schema.sample_file_name").alias("file"),
    )


GENERATE_SQL = f"""WITH {EXAMPLE_CTES} SELECT id, category, difficulty, user_query,
  array_to_string(headers, '|') AS headers, array_to_string(canonical, '|') AS canonical,
  array_to_string(dtypes, '|') AS dtypes, array_to_string(noise, '|') AS noise, n_rows, file FROM ex"""


def derived_calls(spark, folder):
    return _examples(spark, folder).select(
        "id", F.size("tool_calls").cast("bigint").alias("n_calls"), tc.assistant_content(F.col("tool_calls")).alias("answer")
    )


def _spoiled(spark, folder):
    """Examples with broken calls by id: method, tool name, metric list or chart type."""
    rows = _examples(spark, folder)
    i = F.col("id")

    def spoil(c):
        p = c["params"]
        a = p["arguments"]
        name = F.when(i % 13 == 2, "drop_table").otherwise(p["name"])
        args = a.withField("metrics", F.when(i % 13 != 3, a["metrics"])).withField(
            "chart_type", F.when(i % 13 == 4, "radar").otherwise(a["chart_type"])
        )
        return (
            c.withField("method", F.when(i % 13 == 1, "tools/run").otherwise(c["method"]))
            .withField("params", p.withField("name", name).withField("arguments", args))
        )

    return rows.withColumn("tool_calls", F.transform("tool_calls", spoil))


def validate(spark, folder):
    # Staged: a test on computed calls would move below the deal, with all that builds them repeated inside it.
    rows = stage(_spoiled(spark, folder).select("id", "category", "tool_calls"), "records")
    return tc.valid_examples(rows).select("id", "category")


_HAS_KPI = "category IN ('clean', 'noisy', 'adversarial', 'multi_step')"
_HAS_CHART = "category IN ('chart_only', 'multi_step')"
_VALID = f"""category = 'no_tool' OR (
  id % 13 NOT IN (1, 2) AND NOT (id % 13 = 3 AND {_HAS_KPI}) AND NOT (id % 13 = 4 AND {_HAS_CHART}))"""
VALIDATE_SQL = f"WITH {EXAMPLE_CTES} SELECT id, category FROM ex WHERE {_VALID}"


def distinct(spark, folder):
    return tc.distinct_examples(_examples(spark, folder)).select("id", "category", "user_query")


def counts(spark, folder):
    return tc.category_counts(tc.distinct_examples(_examples(spark, folder)))


def split(spark, folder):
    return tc.split(_examples(spark, folder)).select("id", "category", "split")


SPLIT_SQL = f"""WITH ids AS (SELECT event_id AS id, {_KIND.replace('id %', 'event_id %')} AS category FROM events),
r AS (SELECT id, category, category = 'adversarial' AS hard,
  row_number() OVER (PARTITION BY category = 'adversarial' ORDER BY {_draw('split', 7, width=13)}, id) AS rn,
  count(*) OVER (PARTITION BY category = 'adversarial') AS n FROM ids)
SELECT id, category, CASE WHEN hard AND rn <= floor(n * 0.3) THEN 'train' WHEN hard THEN 'adversarial_test'
  WHEN rn <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM r"""


def chat_rows(spark, folder):
    rows = tc.chat_rows(_examples(spark, folder))
    content = lambda n: F.col("messages")[n]["content"]
    return rows.select(
        "id", F.md5(content(0)).alias("system_digest"), content(1).alias("user_text"), content(2).alias("answer"),
        F.array_join("messages.role", ",").alias("roles"), F.col("_category").alias("category"),
        F.col("_difficulty").alias("difficulty"),
    )


CHAT_ROWS_SQL = f"""WITH {EXAMPLE_CTES} SELECT id, md5({lit(fixed.TOOL_SYSTEM_PROMPT)}) AS system_digest,
  context || E'\\n\\nUser request: ' || user_query AS user_text, answer, 'system,user,assistant' AS roles,
  category, difficulty FROM shown"""

# Public function-calling rows from events: some with broken lists, missing
# messages or unreadable arguments.
_TOOLS = (
    "CASE event_id % 11 WHEN 3 THEN 'no list' WHEN 4 THEN '[{\"type\":\"function\",\"function\":{\"name\":\"' || event_type || '\"}}]' "
    "ELSE '[{\"type\":\"function\",\"function\":{\"name\":\"' || event_type || '\",\"description\":\"about ' || event_type || '\"}},"
    "{\"type\":\"function\",\"function\":{\"name\":\"other\",\"description\":\"x\"}}]' END"
)
_ARGS = "CASE WHEN event_id % 7 = 2 THEN 'k: 1' ELSE replace(props, ' ', '') END"


def _public(spark, folder):
    rows = src.table(spark, folder, "events").selectExpr(
        "event_id AS id", "event_type", _TOOLS + " AS tools", _ARGS + " AS args",
    )
    calls_type = "array<struct<type:string,function:struct<name:string,arguments:string>>>"
    user = F.struct(
        F.concat(F.lit("Find "), "event_type").alias("content"), F.lit("user").alias("role"),
        F.lit(None).cast(calls_type).alias("tool_calls"),
    )
    call = F.struct(
        F.lit("function").alias("type"),
        F.struct(F.col("event_type").alias("name"), F.col("args").alias("arguments")).alias("function"),
    )
    answer = F.struct(
        F.lit(None).cast("string").alias("content"),
        F.when(F.col("id") % 17 == 5, "tool").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 5 == 0, F.array().cast(calls_type)).otherwise(F.array(call)).alias("tool_calls"),
    )
    return rows.select("id", F.array(user, answer).alias("messages"), "tools")


def convert(spark, folder):
    rows = tc.convert_public(_public(spark, folder))
    return rows.select(
        "id", F.col("messages")[1]["content"].alias("user_text"), F.col("messages")[2]["content"].alias("answer"),
        F.col("_category").alias("category"),
    )


PUBLIC_CTES = f"""
pub AS (SELECT event_id AS id, event_type, {_TOOLS} AS tools, {_ARGS} AS args FROM events),
conv AS (SELECT id, E'Available tools:\\n- ' || event_type || CASE WHEN id % 11 = 4 THEN ': no description'
    ELSE ': about ' || event_type || E'\\n- other: x' END || E'\\n\\nUser request: Find ' || event_type AS user_text,
  CASE WHEN id % 5 = 0 THEN {lit(fixed.PUBLIC_NO_TOOL_ANSWER)} ELSE
    '{{"tool_calls":[{{"method":"tools/call","params":{{"name":"' || event_type || '","arguments":' ||
    CASE WHEN json_valid(args) THEN args ELSE '{{}}' END || '}}}}]}}' END AS answer, 'public_blend' AS category
  FROM pub WHERE id % 11 <> 3 AND id % 17 <> 5)"""


def blend(spark, folder):
    """Domain rows plus public rows, a fifth of their number."""
    train = stage(tc.chat_rows(_examples(spark, folder)), "train")
    out = tc.blend(train, stage(_public(spark, folder), "public"), train.count() // 5)
    return out.select("id", F.col("_category").alias("category"), F.col("messages")[2]["content"].alias("answer"))


BLEND_SQL = f"""WITH {EXAMPLE_CTES}, {PUBLIC_CTES},
ranked AS (SELECT id, row_number() OVER (ORDER BY {_draw('public', 11, width=13)}, id) AS r FROM pub),
first AS (SELECT id FROM ranked WHERE r <= 3 * (SELECT count(*) // 5 FROM shown)),
picked AS (SELECT * FROM (SELECT conv.*, row_number() OVER (ORDER BY {_draw('public', 11, width=13)}, id) AS r
  FROM conv JOIN first USING (id)) WHERE r <= (SELECT count(*) // 5 FROM shown))
SELECT id, category, answer FROM shown UNION ALL SELECT id, category, answer FROM picked"""


def training_set(spark, folder):
    """From generated records, some of them broken, to the rows of each split."""
    out = tc.training_set(stage(_spoiled(spark, folder), "records"), stage(_public(spark, folder), "public"))
    return out.select("id", "split", F.col("_category").alias("category"), F.col("messages")[2]["content"].alias("answer"))


TRAINING_SET_SQL = f"""WITH {EXAMPLE_CTES}, {PUBLIC_CTES},
once AS MATERIALIZED (SELECT * FROM (SELECT id, category, answer, category = 'adversarial' AS hard,
  row_number() OVER (PARTITION BY user_query, category, canonical ORDER BY id) AS copy FROM shown WHERE {_VALID})
  WHERE copy = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY hard ORDER BY {_draw('split', 7, width=13)}, id) AS place,
  count(*) OVER (PARTITION BY hard) AS n FROM once),
dealt AS MATERIALIZED (SELECT id, category, answer, CASE WHEN hard AND place <= floor(n * 0.3) THEN 'train'
  WHEN hard THEN 'adversarial_test' WHEN place <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split
  FROM placed),
size AS (SELECT count(*) // 5 AS k FROM dealt WHERE split = 'train'),
ranked AS (SELECT id, row_number() OVER (ORDER BY {_draw('public', 11, width=13)}, id) AS r FROM pub),
first AS (SELECT id FROM ranked WHERE r <= 3 * (SELECT k FROM size)),
picked AS (SELECT * FROM (SELECT conv.*, row_number() OVER (ORDER BY {_draw('public', 11, width=13)}, id) AS r
  FROM conv JOIN first USING (id)) WHERE r <= (SELECT k FROM size))
SELECT id, split, category, answer FROM dealt UNION ALL SELECT id, 'train' AS split, category, answer FROM picked"""

# Model outputs derived from the true answers by id.
_BROKEN = "substr(answer, 1, length(answer) - 3)"
_OUTPUT = (
    "CASE id % 9 WHEN 1 THEN '```json' || chr(10) || answer || chr(10) || '```' "
    "WHEN 2 THEN replace(answer, 'calculate_kpis', 'run_sql') "
    "WHEN 3 THEN replace(answer, '\"metrics\":[', '\"metrics\":[\"ghost\",') WHEN 4 THEN " + _BROKEN + " "
    "WHEN 5 THEN 'I cannot help with that.' WHEN 6 THEN 'Sure: ' || answer "
    "WHEN 7 THEN replace(answer, '\"chart_type\":\"line\"', '\"chart_type\":\"radar\"') "
    "WHEN 8 THEN replace(answer, '\"date_column\":\"', '\"date_column\":\"x') ELSE answer END"
)


def _outputs(spark, folder):
    rows = tc.chat_rows(_examples(spark, folder)).withColumn("answer", F.col("messages")[2]["content"])
    return rows.withColumn("output", F.expr(_OUTPUT)).drop("answer")


def scored(spark, folder):
    return evals.score_outputs(_outputs(spark, folder)).select("id", "compliant", "correct", "reasoning_failure")


_J = "json_extract_string"
EVAL_CTES = f"""{EXAMPLE_CTES},
outs AS (SELECT id, category, canonical, headers, calls, {_OUTPUT} AS output FROM shown),
bare AS (SELECT *, trim(regexp_replace(trim(output, E' \\n'), '^```(json)?|```$', '', 'g'), E' \\n') AS t FROM outs),
p AS (SELECT *, CASE WHEN json_valid(t) THEN json_extract(t, '$.tool_calls[*]') END AS pc,
  list_transform(calls, lambda c: {_J}(c, '$.params.name')) AS truth FROM bare),
pn AS (SELECT *, list_transform(pc, lambda c: {_J}(c, '$.params.name')) AS pnames FROM p),
v AS (SELECT *, pc IS NOT NULL AND len(list_filter(pc, lambda c: NOT coalesce({_J}(c, '$.method') = 'tools/call'
      AND CASE {_J}(c, '$.params.name')
        WHEN 'calculate_kpis' THEN json_array_length(c, '$.params.arguments.metrics') > 0
          AND {_J}(c, '$.params.arguments.date_column') <> ''
        WHEN 'generate_chart' THEN {_J}(c, '$.params.arguments.chart_type') IN ('line', 'bar', 'pie')
          AND {_J}(c, '$.params.arguments.metric') <> '' ELSE false END, false))) = 0 AS ok,
  len(list_filter(pc, lambda c:
      len(list_filter(from_json(coalesce(json_extract(c, '$.params.arguments.metrics'), '[]'), '["VARCHAR"]'),
                      lambda m: NOT list_contains(canonical, m))) > 0
      OR coalesce(NOT list_contains(list_concat(canonical, headers), {_J}(c, '$.params.arguments.date_column')), false)
      OR coalesce(NOT list_contains(canonical, {_J}(c, '$.params.arguments.metric')), false))) > 0 AS invents FROM pn),
judged AS (SELECT id, category, (ok OR (pc IS NULL AND NOT contains(output, 'tool_calls'))) AS compliant,
  CASE WHEN len(calls) = 0 AND pc IS NULL THEN true WHEN pc IS NULL THEN false WHEN pnames <> truth THEN false
       ELSE NOT invents END AS correct,
  CASE WHEN len(calls) = 0 AND pc IS NULL THEN false WHEN pc IS NULL THEN false WHEN pnames <> truth THEN true
       ELSE invents END AS reasoning_failure FROM v)"""


def eval_metrics(spark, folder):
    out = evals.eval_metrics(evals.score_outputs(_outputs(spark, folder)))
    return out.withColumnRenamed("_category", "category")


EVAL_SQL = f"""WITH {EVAL_CTES} SELECT category, count(*) AS n,
  round(avg(cast(compliant AS integer)) * 100, 1) AS compliance_percent,
  round(avg(cast(correct AS integer)) * 100, 1) AS correct_percent,
  round(avg(cast(reasoning_failure AS integer)) * 100, 1) AS reasoning_failure_percent
FROM judged GROUP BY ROLLUP (category)"""


def running(spark, folder):
    return evals.running_compliance(evals.score_outputs(_outputs(spark, folder)), "id")


RUNNING_SQL = f"""WITH {EVAL_CTES}, r AS (SELECT row_number() OVER (ORDER BY id) AS row_number,
  round(sum(cast(compliant AS integer)) OVER (ORDER BY id) * 100.0::DOUBLE / count(*) OVER (ORDER BY id), 1)
    AS running_percent FROM judged) SELECT * FROM r WHERE row_number % 25 = 0"""


def parsed_outputs(spark, folder):
    rows = _outputs(spark, folder)
    calls = evals.parse_calls(F.col("output"))
    return rows.select(
        "id", calls.isNotNull().alias("parsed"), F.array_join(F.transform(calls, lambda c: c["params"]["name"]), ",").alias("tools"),
        evals.extract_object(F.col("output")).alias("object"),
    )


PARSED_SQL = f"""WITH {EVAL_CTES} SELECT id, pc IS NOT NULL AS parsed, array_to_string(pnames, ',') AS tools,
  CASE WHEN json_valid(regexp_extract(output, '(?s)\\{{.*\\}}')) THEN nullif(regexp_extract(output, '(?s)\\{{.*\\}}'), '') END
  AS object FROM pn"""


def known(spark, folder):
    rows = tc.chat_rows(_examples(spark, folder))
    canonical, raw = evals.known_columns(F.col("messages")[1]["content"])
    return rows.select(
        "id", F.array_join(canonical, "|").alias("canonical"), F.array_join(raw, "|").alias("raw_headers")
    )


KNOWN_SQL = f"""WITH {EXAMPLE_CTES} SELECT id, array_to_string(canonical, '|') AS canonical,
  array_to_string(list_filter(headers, lambda x, i: list_position(headers, x) = i), '|') AS raw_headers FROM ex"""

# JSON-RPC shaped requests from events.
_TOOL = (
    "CASE event_id % 4 WHEN 0 THEN 'calculate_kpis' WHEN 1 THEN 'generate_chart' WHEN 2 THEN 'generate_chart_set' "
    "ELSE event_type END"
)
_METHOD = (
    "CASE event_id % 6 WHEN 0 THEN 'initialize' WHEN 1 THEN 'tools/list' WHEN 2 THEN 'resources/' || event_type "
    "ELSE 'tools/call' END"
)
_PAYLOAD = (
    "CASE WHEN event_id % 19 = 7 THEN 'not json' ELSE '{\"jsonrpc\":' || CASE WHEN event_id % 23 = 4 THEN '\"1.0\"' "
    "WHEN event_id % 23 = 9 THEN '2.0' ELSE '\"2.0\"' END || ',\"id\":\"r' || event_id || '\",\"method\":\"' || method || '\",\"params\":{\"name\":\"' || tool "
    "|| '\",\"arguments\":{\"k\":' || event_id % 5 || '}}}' END"
)


def _requests(spark, folder):
    rows = src.table(spark, folder, "events").selectExpr(
        "event_id", "user_id AS dataset_id", _TOOL + " AS tool", _METHOD + " AS method"
    )
    return rows.selectExpr("event_id", "dataset_id", _PAYLOAD + " AS payload")


def request_status(spark, folder):
    known_sets = src.table(spark, folder, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey AS dataset_id")
    out = requests.classify(_requests(spark, folder), known_sets)
    return out.select("event_id", "request_id", "tool", "arguments", "outcome", "code", "message")


REQUEST_SQL = f"""WITH r AS (SELECT event_id, user_id, {_TOOL} AS tool, {_METHOD} AS method, event_id % 19 = 7 AS bad,
  event_id % 23 IN (4, 9) AS old, user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS known FROM events),
s AS (SELECT *, bad OR old AS invalid, method = 'tools/call' AS is_call,
  tool IN ('calculate_kpis', 'generate_chart', 'generate_chart_set') AS live FROM r)
SELECT event_id, CASE WHEN NOT bad THEN 'r' || event_id END AS request_id, CASE WHEN NOT bad THEN tool END AS tool,
  CASE WHEN NOT bad THEN '{{"k":' || event_id % 5 || '}}' END AS arguments,
  CASE WHEN invalid THEN 'error' WHEN method IN ('initialize', 'tools/list') THEN method
    WHEN is_call AND NOT known THEN 'error' WHEN is_call AND NOT live THEN 'tool_error' WHEN is_call THEN 'dispatch'
    ELSE 'error' END AS outcome,
  CASE WHEN invalid THEN -32600 WHEN method IN ('initialize', 'tools/list') THEN NULL
    WHEN is_call AND NOT known THEN -32000 WHEN is_call THEN NULL ELSE -32601 END AS code,
  CASE WHEN invalid THEN 'Invalid Request' WHEN method IN ('initialize', 'tools/list') THEN NULL
    WHEN is_call AND NOT known THEN 'Dataset context is required for tools/call'
    WHEN is_call AND NOT live THEN 'Unknown tool: ' || tool WHEN is_call THEN NULL
    ELSE 'Method not found: ' || method END AS message FROM s"""


# Calls with arguments: periods and charts that exist, and one of each that does not.
_CALL = (
    "CASE event_id % 4 WHEN 0 THEN '{\"period\":' || CASE event_id % 3 WHEN 0 THEN '\"ME\"' WHEN 1 THEN 'null' ELSE '\"fortnight\"' END || '}' "
    "WHEN 1 THEN CASE event_id % 3 WHEN 0 THEN '{\"chart_type\":\"bar\",\"x_field\":\"category\"}' WHEN 1 THEN '{\"chart_type\":\"line\"}' "
    "ELSE '{\"chart_type\":\"bar\",\"x_field\":\"planet\"}' END "
    "WHEN 2 THEN '{\"max_charts\":' || CASE event_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '1' ELSE '\"many\"' END || ',\"k\":' || event_id || '}' "
    "ELSE '{}' END"
)
_ANSWER = (
    "total_revenue double, period_count bigint, data_points array<struct<x:string,y:double>>, "
    "charts array<struct<id:string,data_points array<struct<x:string,y:double>>>>, recommendations array<struct<chart_type:string,x_field:string>>"
)


def request_results(spark, folder):
    """Requests of ten datasets of orders, two of them unknown, run and read back."""
    slim = src.table(spark, folder, "events").select("event_id", "user_id", "event_type")
    rows = src.dealt(slim, "event_id").selectExpr(
        "event_id", "user_id % 12 AS dataset_id",
        f"'{{\"jsonrpc\":\"2.0\",\"id\":\"r' || event_id || '\",\"method\":\"tools/call\",\"params\":{{\"name\":\"' || {_TOOL} "
        f"|| '\",\"arguments\":' || {_CALL} || '}}}}' AS payload",
    )
    # Staged: every group of calls and the list of known datasets read these rows.
    canonical = stage(src.sales(spark, folder).withColumn("dataset_id", F.col("id") % 10), "sales")
    known_sets = canonical.select("dataset_id")
    done = dispatch(requests.classify(rows, known_sets), canonical, read=_read_answer)
    return done.select(
        "event_id", "dataset_id", "tool", "is_error", "code",
        F.when(F.col("outcome") == "dispatch", F.col("message").isNotNull()).alias("refused"), "total", "points", "recommended",
    )


def _read_answer(result):
    a = F.from_json(result, _ANSWER)
    charts = F.coalesce(a["charts"], F.when(a["data_points"].isNotNull(), F.array(F.struct(F.lit("").alias("id"), a["data_points"].alias("data_points")))))
    points = F.flatten(F.transform(charts, lambda c: c["data_points"]))
    told = F.aggregate(points, F.lit(0.0), lambda x, p: x + p["y"])
    return {
        "total": F.round(F.coalesce(a["total_revenue"], told), 2),
        "points": F.coalesce(a["period_count"], F.size(points).cast("bigint")),
        "recommended": F.array_join(F.transform(a["recommendations"], lambda r: F.concat(r["chart_type"], F.lit(":"), r["x_field"])), "|"),
    }


REQUEST_RESULTS_SQL = f"""WITH sales AS ({src.SALES_SQL}),
r AS (SELECT event_id, user_id % 12 AS dataset_id, {_TOOL} AS tool, event_id % 4 AS t, event_id % 3 AS a FROM events),
o AS (SELECT id % 10 AS ds, cast(d AS date) AS day, v, category FROM sales WHERE d IS NOT NULL AND v IS NOT NULL),
whole AS (SELECT ds, sum(v) AS total, date_diff('day', min(day), max(day)) + 1 AS days,
  date_diff('month', min(day), max(day)) + 1 AS months, count(DISTINCT category) AS kinds FROM o GROUP BY ds),
bars AS (SELECT ds, sum(y) AS total, count(*) AS n FROM (SELECT ds, category, sum(v) AS y,
  row_number() OVER (PARTITION BY ds ORDER BY sum(v) DESC, category NULLS LAST) AS rn FROM o GROUP BY ds, category) WHERE rn <= 10 GROUP BY ds),
j AS (SELECT r.*, w.total, w.days, w.months, w.kinds >= 2 AS varied, b.total AS bar_total, b.n AS bar_n,
  w.ds IS NULL AS unknown, w.ds IS NOT NULL AND t < 3 AS going FROM r LEFT JOIN whole w ON w.ds = dataset_id LEFT JOIN bars b ON b.ds = dataset_id)
SELECT event_id, dataset_id, tool, NOT going OR a = 2 AS is_error, CASE WHEN unknown THEN -32000 END AS code,
  CASE WHEN going THEN a = 2 END AS refused,
  round(CASE WHEN NOT going OR a = 2 THEN NULL WHEN t = 1 AND a = 0 THEN bar_total WHEN t = 2 AND a = 0 AND varied THEN total + bar_total ELSE total END, 2) AS total,
  CASE WHEN NOT going OR a = 2 THEN NULL WHEN t = 0 AND a = 0 THEN months WHEN t = 1 AND a = 0 THEN bar_n
    WHEN t = 2 AND a = 0 AND varied THEN days + bar_n ELSE days END AS points,
  CASE WHEN going AND a < 2 AND t = 2 THEN CASE WHEN a = 0 AND varied THEN 'line:date|bar:category' ELSE 'line:date' END END AS recommended FROM j"""


def log(spark, folder):
    calls = src.table(spark, folder, "events").selectExpr(
        "user_id AS report_id", "event_id AS seq", _TOOL + " AS tool", "props AS arguments",
        "'value ' || event_type AS output_summary",
    )
    out = requests.tool_log(calls)
    return out.select(
        "report_id", "seq", F.col("entry.name").alias("name"), F.col("entry.inputs")["k"].alias("k"),
        F.col("entry.output_summary").alias("output_summary"),
    )


LOG_SQL = f"""SELECT user_id AS report_id, event_id AS seq, {_TOOL} AS name, json_extract_string(props, '$.k') AS k,
  'value ' || event_type AS output_summary FROM events"""

QUERIES = {
    "toolcall_generate": (generate, GENERATE_SQL),
    "toolcall_derived_calls": (
        derived_calls, f"WITH {EXAMPLE_CTES} SELECT id, len(calls) AS n_calls, answer FROM shown"
    ),
    "toolcall_validate": (validate, VALIDATE_SQL),
    "toolcall_distinct": (distinct, f"WITH {EXAMPLE_CTES} SELECT id, category, user_query FROM uniq"),
    "toolcall_counts": (counts, f"WITH {EXAMPLE_CTES} SELECT category, count(*) AS n FROM uniq GROUP BY category"),
    "toolcall_split": (split, SPLIT_SQL),
    "toolcall_chat_rows": (chat_rows, CHAT_ROWS_SQL),
    "toolcall_convert_public": (convert, f"WITH {PUBLIC_CTES} SELECT id, user_text, answer, category FROM conv"),
    "toolcall_blend": (blend, BLEND_SQL),
    "toolcall_training_set": (training_set, TRAINING_SET_SQL),
    "eval_parse": (parsed_outputs, PARSED_SQL),
    "eval_known_columns": (known, KNOWN_SQL),
    "eval_scores": (
        scored, f"WITH {EVAL_CTES} SELECT id, compliant, correct, reasoning_failure FROM judged"
    ),
    "eval_metrics": (eval_metrics, EVAL_SQL),
    "eval_running": (running, RUNNING_SQL),
    "request_status": (request_status, REQUEST_SQL),
    "request_results": (request_results, REQUEST_RESULTS_SQL),
    "tool_log": (log, LOG_SQL),
}
