"""Chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustkpi.operators import charts
from trustkpi.queries import inputs as src

SEG = ["segment"]


def line(spark, folder):
    return charts.line_chart(src.orders(spark, folder), keys=SEG).withColumn("y", F.round("y", 2))


LINE_SQL = f"""WITH {src.series_sql(src.ORDERS_SQL, 'D')}
SELECT k AS segment, 'revenue-trend' AS chart_id, 'line' AS type, 'Revenue Trend' AS title,
       cast(i AS integer) AS pos, strftime(period, '%Y-%m-%d') AS x, round(revenue, 2) AS y FROM scored"""


def _lines(spark, folder):
    """Order lines with the part brand as category; every 10th part has none."""
    lines = src.table(spark, folder, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    parts = src.table(spark, folder, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS category", "p_type AS region"
    )
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").selectExpr(
        "l_shipdate AS date", "l_extendedprice AS revenue", "category", "region"
    )


LINES_SQL = """SELECT l_shipdate AS d, l_extendedprice AS v,
  CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS category, p_type AS region
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"""


def bar(spark, folder):
    return charts.ranked_chart(_lines(spark, folder), "category").withColumn("y", F.round("y", 2))


def _ranked_sql(dim, kind, title, keyed="", source=LINES_SQL):
    part = f"PARTITION BY {keyed} " if keyed else ""
    head = f"{keyed} AS segment, " if keyed else ""
    group = f"{keyed}, " if keyed else ""
    return f"""WITH g AS (SELECT {group}{dim} AS x, sum(v) AS y FROM ({source}) GROUP BY {group}{dim}),
r AS (SELECT *, row_number() OVER ({part}ORDER BY y DESC, x NULLS LAST) AS pos FROM g)
SELECT {head}'{dim}-{kind}' AS chart_id, '{kind}' AS type, '{title}' AS title, cast(pos AS integer) AS pos,
       coalesce(x, 'Unknown') AS x, {{y}} FROM r WHERE pos <= 10"""


def pie(spark, folder):
    points = charts.with_share(charts.ranked_chart(src.sales(spark, folder), "region", "pie", keys=SEG), SEG)
    return points.withColumn("y", F.round("y", 2)).withColumn("share", F.round("share", 6))


def unknown(spark, folder):
    rows = src.sales(spark, folder).selectExpr(
        "date", "revenue", "segment", "CASE WHEN id % 2 = 0 THEN NULL ELSE category END AS category"
    )
    return charts.ranked_chart(rows, "category", keys=SEG).withColumn("y", F.round("y", 2))


UNKNOWN_SOURCE = (
    f"SELECT k, v, CASE WHEN id % 2 = 0 THEN NULL ELSE category END AS category FROM ({src.SALES_SQL})"
)


def _uneven(spark, folder):
    """One segment has a single category, another a single region."""
    return src.sales(spark, folder).selectExpr(
        "date", "revenue", "segment",
        "CASE WHEN segment = '1-URGENT' THEN 'ONLY' ELSE category END AS category",
        "CASE WHEN segment IN ('1-URGENT', '5-LOW') THEN 'ONE' ELSE region END AS region",
    )


UNEVEN_SQL = f"""SELECT d, v, k, CASE WHEN k = '1-URGENT' THEN 'ONLY' ELSE category END AS category,
  CASE WHEN k IN ('1-URGENT', '5-LOW') THEN 'ONE' ELSE region END AS region FROM ({src.SALES_SQL})"""


def specs(spark, folder):
    return charts.chart_specs(_uneven(spark, folder), 3, SEG)


SPECS_SQL = f"""WITH s AS ({UNEVEN_SQL}),
f AS (SELECT k, 1 AS o, 'line' AS chart_type, 'date' AS x_field FROM s GROUP BY k
  UNION ALL SELECT k, 2, 'bar', 'category' FROM s GROUP BY k HAVING count(DISTINCT category) >= 2
  UNION ALL SELECT k, 3, 'bar', 'region' FROM s GROUP BY k HAVING count(DISTINCT region) >= 2)
SELECT k AS segment, cast(row_number() OVER (PARTITION BY k ORDER BY o) AS integer) AS pos, chart_type, x_field,
       'revenue' AS y_field FROM f"""


def chart_set(spark, folder):
    return charts.chart_set(_uneven(spark, folder), 3, SEG).withColumn("y", F.round("y", 2))


_SET_CTES = f"""{src.series_sql(UNEVEN_SQL, 'D')},
long AS (SELECT k, 'category' AS f, category AS x, v FROM src UNION ALL SELECT k, 'region', region, v FROM src),
sums AS (SELECT k, f, x, sum(v) AS y FROM long GROUP BY ALL),
ok AS (SELECT k, f, row_number() OVER (PARTITION BY k ORDER BY f) + 1 AS chart_pos
       FROM (SELECT k, f FROM sums GROUP BY k, f HAVING count(x) >= 2)),
ranked AS (SELECT k, f, coalesce(x, 'Unknown') AS x, y, chart_pos,
           row_number() OVER (PARTITION BY k, f ORDER BY y DESC, x NULLS LAST) AS pos FROM sums JOIN ok USING (k, f)),
points AS (
  SELECT k AS segment, 'revenue-trend' AS chart_id, 'line' AS type, 'Revenue Trend' AS title,
         cast(i AS integer) AS pos, strftime(period, '%Y-%m-%d') AS x, revenue AS y, 1 AS chart_pos FROM scored
  UNION ALL SELECT k, f || '-bar', 'bar', upper(f[1]) || f[2:] || ' Revenue', cast(pos AS integer), x, y,
         cast(chart_pos AS integer) FROM ranked WHERE pos <= 10)"""
SET_SQL = f"WITH {_SET_CTES} SELECT segment, chart_id, type, title, pos, x, round(y, 2) AS y, chart_pos FROM points"


def chart_facts(spark, folder):
    return charts.chart_insights(charts.chart_set(_uneven(spark, folder), 3, SEG), SEG)


FACTS_SQL = f"""WITH {_SET_CTES},
ends AS (SELECT segment, chart_pos, chart_id, type, title, count(*) AS n, arg_min(x, pos) AS hx, arg_min(y, pos) AS hy,
         arg_max(x, pos) AS tx, arg_max(y, pos) AS ty FROM points GROUP BY ALL)
SELECT segment, chart_pos, chart_id, CASE WHEN type <> 'line' THEN 'The ' || lower(title) || ' is led by ' || hx
   || ' at $' || format('{{:,.2f}}', hy) || '.'
  WHEN n >= 2 THEN 'The trend chart runs from ' || hx || ' to ' || tx || ', with the latest plotted revenue at $'
   || format('{{:,.2f}}', ty) || '.' END AS fact FROM ends"""

QUERIES = {
    "chart_line": (line, LINE_SQL),
    "chart_bar_top_ten": (
        bar, _ranked_sql("category", "bar", "Category Revenue").format(y="round(y, 2) AS y")
    ),
    "chart_pie_share": (
        pie,
        _ranked_sql("region", "pie", "Region Revenue Mix", "k", src.SALES_SQL).format(
            y="round(y, 2) AS y, round(y / sum(y) OVER (PARTITION BY k), 6) AS share"
        ),
    ),
    "chart_unknown_bucket": (
        unknown,
        _ranked_sql("category", "bar", "Category Revenue", "k", UNKNOWN_SOURCE).format(y="round(y, 2) AS y"),
    ),
    "chart_specs": (specs, SPECS_SQL),
    "chart_set": (chart_set, SET_SQL),
    "chart_facts": (chart_facts, FACTS_SQL),
}
