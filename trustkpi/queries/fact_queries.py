"""Report text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions import text
from trustkpi.operators import charts, facts, kpi
from trustkpi.operators.keyed import attach
from trustkpi.queries import inputs as src
from trustkpi.session import stage

SEG = ["segment"]


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def filled(template: str, **values: str) -> str:
    """SQL concatenation of a text template."""
    out = lit(template)
    for name, expression in values.items():
        out = out.replace("{" + name + "}", f"' || {expression} || '")
    return "(" + out + ")"


def _trust(spark, folder):
    """Quality facts per priority: share of orders with a copy; one priority has none."""
    pct = (
        "CASE WHEN segment = '5-LOW' THEN 0.0D "
        "ELSE round(avg(CASE WHEN id % 40 = 0 THEN 1.0D ELSE 0.0D END), 4) END"
    )
    grouped = src.orders(spark, folder).groupBy("segment").agg(F.expr(pct).alias("duplicate_percent"))
    return grouped.selectExpr(
        "segment", "duplicate_percent", "round(1.0D - duplicate_percent * 2.0D, 4) AS quality_score",
        f"CASE WHEN duplicate_percent > 0 THEN array('{fixed.WARN_DUPLICATES}') "
        "ELSE cast(array() AS array<string>) END AS warnings",
    )


def _inputs(spark, folder):
    rows = src.sales(spark, folder)
    numbers = stage(kpi.kpi_report(rows, "D", SEG), "kpis")
    drawn = charts.chart_set(rows, 3, SEG)
    return facts.fact_inputs(numbers, drawn, _trust(spark, folder), SEG)


def _report(spark, folder):
    return facts.fact_report(_inputs(spark, folder), SEG)


def _money(e: str) -> str:
    return f"'$' || format('{{:,.2f}}', {e})"


_VALUES = {
    "total": _money("total_revenue"), "average": _money("average_revenue"),
    "growth": "printf('%.2f', growth_rate) || '%'", "rows": "cast(row_count AS varchar)",
    "latest": "strftime(latest_period, '%Y-%m-%d')", "count": "cast(anomaly_count AS varchar)",
    "dates": "array_to_string(dates[1:3], ', ')", "score": "cast(score AS varchar)",
}


def _f(template: str) -> str:
    return filled(template, **_VALUES)


def _either(some: str, none: str) -> str:
    return f"CASE WHEN anomaly_count > 0 THEN {_f(some)} ELSE {lit(none)} END"


_DUP_TEXT = filled(fixed.DUPLICATE_RATE, percent="cast(round(pct * 100, 2) AS varchar)")
FACT_CTES = f"""{src.kpi_sql(src.SALES_SQL, 'D')},
hits AS (SELECT k, list(strftime(period, '%Y-%m-%d') ORDER BY period) FILTER (hit) AS dates,
  arg_min(strftime(period, '%Y-%m-%d'), i) AS fx, arg_max(strftime(period, '%Y-%m-%d'), i) AS tx,
  arg_max(revenue, i) AS ty FROM scored GROUP BY k),
trust AS (SELECT k, CASE WHEN k = '5-LOW' THEN 0.0 ELSE round(avg(CASE WHEN id % 40 = 0 THEN 1.0 ELSE 0.0 END), 4) END
  AS pct FROM src GROUP BY k),
joined AS (SELECT *, round(1.0 - pct * 2.0, 4) AS score,
  {filled(fixed.CHART_FACT_LINE, first="fx", last="tx", value=_money("ty"))} AS chart_fact,
  CASE WHEN pct > 0 THEN ['{fixed.WARN_DUPLICATES}', {_DUP_TEXT}] ELSE [] END AS warnings
  FROM kpi JOIN hits USING (k) JOIN trust USING (k)),
f AS (SELECT *,
  {_f(fixed.SUMMARY_TOTAL)} AS s1, {_f(fixed.SUMMARY_LATEST)} AS s2,
  {_either(fixed.SUMMARY_ANOMALIES, fixed.SUMMARY_NO_ANOMALIES)} AS s3, {_f(fixed.SUMMARY_QUALITY)} AS s5,
  {_f(fixed.INSIGHT_BASELINE)} AS i1, {_f(fixed.INSIGHT_MOVEMENT)} AS i2a,
  {_either(fixed.INSIGHT_ANOMALIES, fixed.INSIGHT_NO_ANOMALIES)} AS i2b,
  coalesce(warnings[1], {_f(fixed.INSIGHT_QUALITY)}) AS i4,
  {_f(fixed.STORY_OVERVIEW)} || chart_fact AS c1,
  {_f(fixed.STORY_TREND)} || {_either(fixed.STORY_ANOMALIES, fixed.STORY_NO_ANOMALIES)} AS c2,
  coalesce(warnings[1], {_f(fixed.STORY_QUALITY)}) AS c3 FROM joined)"""

_INSIGHTS = """[{'title': 'Revenue Baseline', 'body': i1, 'tone': 'neutral'},
  {'title': 'Recent Movement', 'body': i2a || i2b, 'tone': CASE WHEN growth_rate >= 0 THEN 'positive' ELSE 'caution' END},
  {'title': 'Chart Readout', 'body': chart_fact, 'tone': 'neutral'},
  {'title': 'Data Quality', 'body': i4, 'tone': CASE WHEN len(warnings) > 0 THEN 'caution' ELSE 'neutral' END}]"""
_STORY = "[" + ", ".join(
    f"{{'id': 'story-{n}', 'eyebrow': '{n.title()}', 'headline': {lit(fixed.STORY_HEADLINES[n])}, 'copy': {c}, "
    f"'chart_id': '{chart}'}}"
    for n, c, chart in (
        ("overview", "c1", "revenue-trend"), ("trend", "c2", "revenue-trend"), ("risk", "c3", "category-bar")
    )
) + "]"


def summary(spark, folder):
    return _report(spark, folder).select(
        "segment", "title", "summary", F.array_join("warnings", "|").alias("warnings"),
        F.array_join("suggested_questions", "|").alias("questions"),
    )


SUMMARY_SQL = f"""WITH {FACT_CTES} SELECT k AS segment, {lit(fixed.REPORT_TITLE)} AS title,
  s1 || ' ' || s2 || ' ' || s3 || ' ' || chart_fact || ' ' || s5 AS summary,
  array_to_string(warnings, '|') AS warnings, {lit('|'.join(fixed.REPORT_QUESTIONS))} AS questions FROM f"""


def insights(spark, folder):
    return _report(spark, folder).select("segment", F.inline("insights"))


def story(spark, folder):
    return _report(spark, folder).select("segment", F.inline("story"))


def export(spark, folder):
    return facts.insight_export(_report(spark, folder), SEG)


EXPORT_SQL = f"""WITH {FACT_CTES} SELECT k AS segment, cast(to_json({{'title': {lit(fixed.REPORT_TITLE)},
  'summary': s1 || ' ' || s2 || ' ' || s3 || ' ' || chart_fact || ' ' || s5,
  'insights': {_INSIGHTS}, 'story': {_STORY}}}) AS varchar) AS payload FROM f"""


def sections(spark, folder):
    return facts.sections(_report(spark, folder), SEG)


_ASKED = ", ".join(lit(x.removesuffix("?")) for x in fixed.REPORT_QUESTIONS)
SECTIONS_SQL = f"""WITH {FACT_CTES},
parts AS (
  SELECT k, 'overview' AS section, [s1, s2, {lit(fixed.STORY_HEADLINES['overview'])}] AS lines FROM f
  UNION ALL SELECT k, 'insights', list_filter(['Revenue Baseline: ' || i1,
    CASE WHEN growth_rate >= 0 THEN 'Recent Movement: ' || trim(i2a) END, 'Chart Readout: ' || chart_fact,
    CASE WHEN len(warnings) = 0 THEN 'Data Quality: ' || i4 END], lambda x: x IS NOT NULL) FROM f
  UNION ALL SELECT k, 'risks', list_filter(list_concat(warnings, [
    CASE WHEN growth_rate < 0 THEN 'Recent Movement: ' || trim(i2a) END,
    CASE WHEN len(warnings) > 0 THEN 'Data Quality: ' || i4 END]), lambda x: x IS NOT NULL) FROM f
  UNION ALL SELECT k, 'opportunities', [{lit(fixed.STORY_HEADLINES['trend'])}, {_ASKED}] FROM f)
SELECT k AS segment, section, cast(unnest(generate_series(1, least(3, len(lines)))) AS integer) AS pos,
  unnest(lines[1:3]) AS line FROM parts"""

_SEGMENTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def chat(spark, folder):
    numbers = kpi.kpi_report(src.orders(spark, folder), "ME", SEG)
    reports = attach(numbers, _trust(spark, folder), SEG).withColumn(
        "status", F.when(F.col("segment") == "4-NOT SPECIFIED", "failed").otherwise("success")
    ).withColumnRenamed("segment", "report_id")
    questions = src.table(spark, folder, "conversations").selectExpr(
        "conv_id * 1000 + turn AS question_id",
        f"element_at(array({', '.join(map(lit, _SEGMENTS))}), cast(conv_id % 5 + 1 AS int)) AS report_id",
        "CASE WHEN turn % 7 = 6 THEN ' ' ELSE text END AS message",
    )
    return facts.answer_questions(questions, reports).select(
        "question_id", "report_id", "answer", F.array_join("follow_ups", "|").alias("follow_ups")
    )


def _plain(e: str) -> str:
    return f"regexp_replace(regexp_replace(cast(cast(round({e}, 6) AS decimal(30,6)) AS varchar), '0+$', ''), '\\.$', '.0')"


CHAT_SQL = f"""WITH {src.kpi_sql(src.ORDERS_SQL, 'ME')},
hits AS (SELECT k, list(strftime(period, '%Y-%m-%d') ORDER BY period) FILTER (hit) AS dates FROM scored GROUP BY k),
trust AS (SELECT k, CASE WHEN k = '5-LOW' THEN 0.0 ELSE round(avg(CASE WHEN id % 40 = 0 THEN 1.0 ELSE 0.0 END), 4) END
  AS pct FROM src GROUP BY k),
ans AS (SELECT k, {filled(fixed.CHAT_ANSWER, total=_plain('total_revenue'), growth=_plain('growth_rate'),
    average=_plain('average_revenue'),
    dates="'[' || coalesce(array_to_string(list_transform(dates, lambda x: '''' || x || ''''), ', '), '') || ']'")}
  || CASE WHEN pct > 0 THEN {filled(fixed.CHAT_DUPLICATES, percent=_plain('round(pct * 100, 2)'))} ELSE '' END AS a
  FROM kpi JOIN hits USING (k) JOIN trust USING (k)),
asked AS (SELECT conv_id * 1000 + turn AS question_id, [{', '.join(map(lit, _SEGMENTS))}][conv_id % 5 + 1] AS report_id
  FROM conversations WHERE turn % 7 <> 6 AND length(trim(text, E' \\t\\n\\r')) BETWEEN 1 AND 1000)
SELECT question_id, report_id, CASE WHEN report_id = '4-NOT SPECIFIED' THEN {lit(fixed.GATE_CHAT_ANSWER)} ELSE a END
  AS answer, CASE WHEN report_id = '4-NOT SPECIFIED' THEN '' ELSE {lit('|'.join(fixed.CHAT_QUESTIONS))} END AS follow_ups
FROM asked JOIN ans ON report_id = k"""


def first_sentences(spark, folder):
    """First three sentences of whole documents."""
    rows = src.table(spark, folder, "documents").select("doc_id", text.first_sentences("text", 3).alias("s"))
    return rows.select(
        "doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "\n")).alias("digest")
    )


SENTENCES_SQL = """WITH p AS (SELECT doc_id, list_filter(list_transform(
  string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> '')[1:3] AS s FROM documents)
SELECT doc_id, len(s) AS n, md5(array_to_string(s, E'\\n')) AS digest FROM p"""

# Supplied report texts by customer: some generic, some empty, some with their own story.
_SUMMARY = (
    "CASE c_custkey % 5 WHEN 0 THEN 'The Agent Generated this for ' || c_name WHEN 1 THEN '' "
    "WHEN 2 THEN NULL ELSE 'Sales of ' || c_name || ' grew.' END"
)
_COPY = "CASE c_custkey % 7 WHEN 3 THEN 'Built with approved analytics tools.' ELSE 'Balance ' || c_mktsegment END"


def _supplied(spark, folder):
    return src.table(spark, folder, "customer").selectExpr(
        "c_custkey", _SUMMARY + " AS summary", _COPY + " AS copy", "c_mktsegment",
    )


def generic(spark, folder):
    rows = _supplied(spark, folder).withColumn(
        "story", F.array(F.struct(F.lit("Head").alias("headline"), F.col("copy").alias("copy")))
    )
    return rows.select("c_custkey", facts.is_generic(F.col("summary"), F.col("story")).alias("generic"))


GENERIC_SQL = f"""SELECT c_custkey, (c_custkey % 5 = 0 OR c_custkey % 7 = 3) AS generic FROM customer"""


def chosen(spark, folder):
    supplied = _supplied(spark, folder).select(
        "c_custkey",
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Report "), "c_mktsegment")).alias("title"),
        "summary",
        F.when(
            F.col("c_custkey") % 3 == 0,
            F.array(F.struct(F.lit("Own").alias("title"), F.col("copy").alias("body"), F.lit("neutral").alias("tone"))),
        ).alias("insights"),
        F.array(
            F.struct(
                F.lit("s").alias("id"), F.lit("E").alias("eyebrow"), F.lit("Head").alias("headline"),
                F.col("copy").alias("copy"), F.lit("revenue-trend").alias("chart_id"),
            )
        ).alias("story"),
        F.lit(None).cast("array<string>").alias("suggested_questions"),
        F.array(F.lit("Late data"), F.concat(F.lit("Check "), "c_mktsegment")).alias("warnings"),
    )
    base = src.table(spark, folder, "customer").select(
        "c_custkey", F.lit("Facts").alias("title"), F.concat(F.lit("Balance of "), "c_name").alias("summary"),
        F.array(
            F.struct(F.lit("Base").alias("title"), F.col("c_name").alias("body"), F.lit("neutral").alias("tone"))
        ).alias("insights"),
        F.array(
            F.struct(
                F.lit("f").alias("id"), F.lit("F").alias("eyebrow"), F.lit("Fact").alias("headline"),
                F.col("c_name").alias("copy"), F.lit("revenue-trend").alias("chart_id"),
            )
        ).alias("story"),
        F.array(F.lit("Why?")).alias("suggested_questions"),
        F.array(F.lit("Late data"), F.lit("Few rows")).alias("warnings"),
    )
    own = src.table(spark, folder, "customer").where("c_custkey % 4 <> 0").select(
        "c_custkey", F.array(F.lit("Few rows")).alias("warnings")
    )
    out = facts.choose_texts(supplied, base, ["c_custkey"], own)
    return out.select(
        "c_custkey", "title", "summary", F.col("insights")[0]["title"].alias("insight"),
        F.col("story")[0]["id"].alias("story_id"), F.array_join("suggested_questions", "|").alias("questions"),
        F.array_join("warnings", "|").alias("warnings"),
    )


CHOSEN_SQL = f"""WITH s AS (SELECT *, {_SUMMARY} AS summary, (c_custkey % 5 = 0 OR c_custkey % 7 = 3) AS g FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Report ' || c_mktsegment ELSE 'Facts' END AS title,
  CASE WHEN NOT g AND summary <> '' THEN summary ELSE 'Balance of ' || c_name END AS summary,
  CASE WHEN NOT g AND c_custkey % 3 = 0 THEN 'Own' ELSE 'Base' END AS insight,
  CASE WHEN g THEN 'f' ELSE 's' END AS story_id, 'Why?' AS questions,
  CASE WHEN c_custkey % 4 <> 0 THEN 'Few rows|Late data|Check ' || c_mktsegment
       ELSE 'Late data|Check ' || c_mktsegment || '|Few rows' END AS warnings FROM s"""


def defaults(spark, folder):
    """Stored reports with gaps, one per customer."""
    i = F.col("c_custkey")
    rows = src.table(spark, folder, "customer").select(
        "c_custkey",
        F.when(i % 3 == 0, "failed").otherwise("success").alias("status"),
        F.when(i % 6 == 0, fixed.REASON_QUALITY).alias("reason"),
        F.when(i % 4 == 1, F.col("c_name")).alias("title"),
        F.when(i % 5 == 1, F.concat(F.lit("About "), "c_name")).alias("summary"),
        F.lit(None).cast("array<struct<title:string,body:string,tone:string>>").alias("insights"),
        F.lit(None).cast(
            "array<struct<id:string,eyebrow:string,headline:string,copy:string,chart_id:string>>"
        ).alias("story"),
        F.lit(None).cast("array<string>").alias("suggested_questions"),
        F.array(F.lit("Dataset quality score is 0.9"), F.concat(F.lit("Check "), "c_mktsegment")).alias("warnings"),
        F.when(i % 2 == 0, i).alias("row_count"),
        F.when(i % 7 != 0, i + 1).alias("row_count_after_cleaning"),
        F.when(i % 3 != 0, "revenue-trend").alias("first_chart"),
    )
    out = facts.with_defaults(rows, ["c_custkey"])
    return out.select(
        "c_custkey", "title", "summary", F.col("insights")[0]["body"].alias("insight"),
        F.col("story")[0]["headline"].alias("headline"), F.col("story")[0]["copy"].alias("copy"),
        F.col("story")[0]["chart_id"].alias("chart_id"),
        F.array_join("suggested_questions", "|").alias("questions"), F.array_join("warnings", "|").alias("warnings"),
        "row_count",
    )


DEFAULTS_SQL = f"""WITH c AS (SELECT *, c_custkey % 3 = 0 AS failed,
  CASE WHEN c_custkey % 6 = 0 THEN {lit(fixed.REASON_QUALITY)} END AS reason FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN c_name WHEN failed THEN {lit(fixed.GATE_TITLE)}
    ELSE {lit(fixed.DEFAULT_TITLE)} END AS title,
  CASE WHEN c_custkey % 5 = 1 THEN 'About ' || c_name WHEN failed THEN coalesce(reason, {lit(fixed.GATE_SUMMARY_REASON)})
    || ' Review the quality warnings before retrying.' ELSE {lit(fixed.DEFAULT_SUMMARY)} END AS summary,
  'Check ' || c_mktsegment AS insight,
  CASE WHEN failed THEN {lit(fixed.GATE_STORY['headline'])} ELSE {lit(fixed.DEFAULT_STORY['headline'])} END AS headline,
  CASE WHEN failed THEN coalesce(reason, {lit(fixed.GATE_STORY['copy'])}) ELSE {lit(fixed.DEFAULT_STORY['copy'])} END AS copy,
  CASE WHEN NOT failed THEN 'revenue-trend' END AS chart_id, {lit('|'.join(fixed.DEFAULT_QUESTIONS))} AS questions,
  'Check ' || c_mktsegment AS warnings,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey WHEN c_custkey % 7 <> 0 THEN c_custkey + 1 ELSE 0 END AS row_count FROM c"""


def panel(spark, folder):
    rows = src.table(spark, folder, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 3 WHEN 0 THEN cast(NULL AS array<string>) "
        "WHEN 1 THEN array('Show regional trends', 'About ' || c_name) "
        "ELSE array('A?', 'B?', c_name, 'C?', 'D?') END AS given",
    )
    return rows.select("c_custkey", F.array_join(facts.panel_questions(F.col("given")), "|").alias("questions"))


_PANEL = lit("|".join(fixed.PANEL_QUESTIONS))
PANEL_SQL = f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN {_PANEL} WHEN 1 THEN {_PANEL} || '|About ' || c_name
  ELSE {_PANEL} || '|A?|B?|' || c_name END AS questions FROM customer"""


def number_texts(spark, folder):
    rows = src.table(spark, folder, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS v"
    )
    card = lambda kind: text.card_text("v", F.lit(kind))
    return rows.select(
        "c_custkey", text.currency_text("v").alias("money"), text.percent_text("v").alias("percent"),
        card("currency").alias("card_money"), card("percent").alias("card_percent"), card("count").alias("card_count"),
    )


NUMBER_TEXTS_SQL = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS v FROM customer)
SELECT c_custkey, coalesce('$' || format('{:,.2f}', v), 'unavailable') AS money,
  coalesce(printf('%.2f', v) || '%', 'unavailable') AS percent,
  coalesce((CASE WHEN round(v) < 0 THEN '-$' ELSE '$' END) || format('{:,.0f}', abs(round(v))), 'N/A') AS card_money,
  coalesce(printf('%.1f', CASE WHEN (abs(v) * 4) % 4 = 1 THEN v + sign(v) * 0.01 ELSE v END) || '%', 'N/A') AS card_percent,
  coalesce(format('{:,.0f}', v), 'N/A') AS card_count FROM c"""

QUERIES = {
    "fact_summary": (summary, SUMMARY_SQL),
    "fact_insights": (
        insights,
        f"WITH {FACT_CTES}, r AS (SELECT k, unnest({_INSIGHTS}) AS u FROM f) "
        "SELECT k AS segment, u.title AS title, u.body AS body, u.tone AS tone FROM r",
    ),
    "fact_story": (
        story,
        f"WITH {FACT_CTES}, r AS (SELECT k, unnest({_STORY}) AS u FROM f) SELECT k AS segment, u.id AS id, "
        "u.eyebrow AS eyebrow, u.headline AS headline, u.copy AS copy, u.chart_id AS chart_id FROM r",
    ),
    "insight_export": (export, EXPORT_SQL),
    "report_sections": (sections, SECTIONS_SQL),
    "chat_answers": (chat, CHAT_SQL),
    "first_sentences": (first_sentences, SENTENCES_SQL),
    "generic_texts": (generic, GENERIC_SQL),
    "chosen_texts": (chosen, CHOSEN_SQL),
    "report_defaults": (defaults, DEFAULTS_SQL),
    "panel_questions": (panel, PANEL_SQL),
    "number_texts": (number_texts, NUMBER_TEXTS_SQL),
}
