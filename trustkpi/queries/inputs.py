"""Inputs of the registered queries, as DataFrames and as SQL.

Canonical rows come straight from the tables. The messy text table spells the
typed columns in many ways, depending on the row's key, so that both engines
start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustkpi.session import stage

SALES_KEY = ["dataset"]
SALES_COLUMNS = ["order date", "net revenue", "product category", "region", "price", "quantity", "notes"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Slim rows dealt by ``key``. A number is given because the planner would put so few bytes in one task,
    and what is built from them costs far more than they do."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def orders(spark, folder) -> DataFrame:
    """Canonical date and revenue, with the priority as dataset key."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "o_orderdate AS date", "o_totalprice AS revenue", "o_orderpriority AS segment"
    )


ORDERS_SQL = (
    "SELECT o_orderkey AS id, o_orderdate AS d, o_totalprice AS v, o_orderpriority AS k FROM orders"
)


def sales(spark, folder) -> DataFrame:
    """Canonical orders with market segment as category and region name as region."""
    joined = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    return joined.selectExpr(
        "o_orderkey AS id", "o_orderdate AS date", "o_totalprice AS revenue", "o_orderpriority AS segment",
        "c_mktsegment AS category", "r_name AS region",
    )


SALES_SQL = """
SELECT o_orderkey AS id, o_orderdate AS d, o_totalprice AS v, o_orderpriority AS k,
       c_mktsegment AS category, r_name AS region
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
"""

# Same text in both dialects; %(iso)s etc. stand for the date formats.
_REVENUE = (
    "CASE WHEN {holes} AND id % 97 = 5 THEN 'bad' WHEN {holes} AND id % 89 = 3 THEN '   ' "
    "WHEN id % 53 = 7 THEN '(' || amount || ')' WHEN id % 7 = 0 THEN '$' || amount "
    "WHEN id % 7 = 1 THEN ' ' || amount || ' ' WHEN id % 7 = 2 THEN amount || ' USD' ELSE amount END"
)
_CATEGORY = (
    "CASE id % 4 WHEN 0 THEN lower(category) WHEN 1 THEN '  ' || category "
    "WHEN 2 THEN category || ' ' ELSE category END"
)
_REGION = "CASE id % 3 WHEN 0 THEN lower(region) WHEN 1 THEN ' ' || region || '  ' ELSE region END"
_COPY_REGION = "CASE WHEN copy = 2 THEN upper(region) ELSE " + _REGION + " END"
# Whole cents times a decimal cent, so no engine has to round.
_PRICE = (
    "cast(cast(floor({v} * 100 / (1 + id % 9)) AS decimal(18,0)) * cast('0.01' AS decimal(3,2)) AS {text})"
)
_DATE = "CASE id % 3 WHEN 0 THEN {iso} WHEN 1 THEN {us} ELSE {words} END"


def raw_sales(spark, folder, holes: bool) -> DataFrame:
    """Messy text rows per priority; every 40th order twice, the copy spelled differently.

    ``holes`` adds unreadable and blank revenues.
    """
    # Narrow rows are dealt before their texts are built: to as many tasks as a scan of text files has.
    base = dealt(sales(spark, folder), "id").selectExpr(
        "id", "segment AS dataset", "date", "category", "region",
        "cast(cast(revenue AS decimal(18,2)) AS string) AS amount",
        _PRICE.format(v="revenue", text="string") + " AS price",
        "explode(CASE WHEN id % 40 = 0 THEN array(1, 2) ELSE array(1) END) AS copy",
    )
    flag = "true" if holes else "false"
    texts = base.selectExpr(
        "id * 2 + copy AS _pos",
        "dataset",
        _DATE.format(
            iso="date_format(date, 'yyyy-MM-dd')", us="date_format(date, 'MM/dd/yyyy')",
            words="date_format(date, 'd MMM yyyy')",
        ) + " AS `order date`",
        _REVENUE.format(holes=flag) + " AS `net revenue`",
        _CATEGORY + " AS `product category`",
        _COPY_REGION + " AS region",
        "price",
        "cast(1 + id % 9 AS string) AS quantity",
        "cast(NULL AS string) AS notes",
    )
    # Staged: state, counts and cleaning each read these texts, as they would read a file.
    return stage(texts, "raw")


def raw_sales_sql(holes: bool) -> str:
    flag = "true" if holes else "false"
    date = _DATE.format(
        iso="strftime(d, '%Y-%m-%d')", us="strftime(d, '%m/%d/%Y')", words="strftime(d, '%-d %b %Y')"
    )
    return f"""
SELECT id * 2 + copy AS _pos, dataset, {date} AS "order date",
       {_REVENUE.format(holes=flag)} AS "net revenue", {_CATEGORY} AS "product category",
       {_COPY_REGION} AS region, price, cast(1 + id % 9 AS varchar) AS quantity,
       cast(NULL AS varchar) AS notes
FROM (SELECT id, k AS dataset, d, category, region,
             cast(cast(v AS decimal(18,2)) AS varchar) AS amount,
             {_PRICE.format(v="v", text="varchar")} AS price,
             unnest(CASE WHEN id % 40 = 0 THEN [1, 2] ELSE [1] END) AS copy
      FROM ({SALES_SQL}))
"""


# --- SQL forms of the column functions ---------------------------------------


def norm_sql(e: str) -> str:
    return f"nullif(trim(regexp_replace({e}, '\\s+', ' ', 'g')), '')"


def title_sql(e: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({e}), '(\\p{{L}}+|\\P{{L}}+)'), "
        "lambda x: upper(x[1]) || x[2:]), '')"
    )


def label_sql(e: str) -> str:
    return f"(CASE WHEN {norm_sql(e)} IS NOT NULL THEN {title_sql(norm_sql(e))} END)"


def number_sql(e: str) -> str:
    signed = f"regexp_replace(trim({e}), '^\\((.*)\\)$', '-\\1')"
    value = f"try_cast(nullif(regexp_replace({signed}, '[^0-9.+eE\\-]', '', 'g'), '') AS double)"
    return f"nullif(nullif({value}, cast('inf' AS double)), cast('-inf' AS double))"


def date_sql(e: str) -> str:
    t = f"trim({e})"
    return (
        f"CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime({t}, '%Y-%m-%d') "
        f"WHEN regexp_full_match({t}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') "
        f"THEN coalesce(try_strptime({t}, '%m/%d/%Y'), try_strptime({t}, '%d/%m/%Y')) "
        f"WHEN regexp_full_match({t}, '\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}}') THEN try_strptime({t}, '%d %b %Y') END"
    )


# Base period, step and label of each series kind in SQL.
PERIODS = {
    "D": ("cast(d AS date)", "INTERVAL 1 DAY", "cast(b AS date)"),
    "W": ("cast(date_trunc('week', d) AS date)", "INTERVAL 7 DAY", "cast(b AS date) + 6"),
    "ME": ("cast(date_trunc('month', d) AS date)", "INTERVAL 1 MONTH", "last_day(cast(b AS date))"),
    "MS": ("cast(date_trunc('month', d) AS date)", "INTERVAL 1 MONTH", "cast(b AS date)"),
    "QE": (
        "cast(date_trunc('quarter', d) AS date)", "INTERVAL 3 MONTH",
        "last_day(cast(cast(b AS date) + INTERVAL 2 MONTH AS date))",
    ),
    "YE": ("cast(date_trunc('year', d) AS date)", "INTERVAL 1 YEAR", "make_date(year(cast(b AS date)), 12, 31)"),
    "h": ("date_trunc('hour', d)", "INTERVAL 1 HOUR", "cast(b AS timestamp)"),
    "7D": (
        "cast(min(cast(d AS date)) OVER (PARTITION BY k) AS date) "
        "+ cast(floor((cast(d AS date) - min(cast(d AS date)) OVER (PARTITION BY k)) / 7) * 7 AS integer)",
        "INTERVAL 7 DAY", "cast(b AS date)",
    ),
    "2W": (
        "cast(min(date_trunc('week', d)) OVER (PARTITION BY k) AS date) + cast(ceil((cast(date_trunc('week', d) AS date) "
        "- cast(min(date_trunc('week', d)) OVER (PARTITION BY k) AS date)) / 14.0) * 14 AS integer)",
        "INTERVAL 14 DAY", "cast(b AS date) + 6",
    ),
    "2ME": (
        "cast(min(date_trunc('month', d)) OVER (PARTITION BY k) + to_months(cast(ceil(date_diff('month', "
        "min(date_trunc('month', d)) OVER (PARTITION BY k), date_trunc('month', d)) / 2.0) * 2 AS integer)) AS date)",
        "INTERVAL 2 MONTH", "last_day(cast(b AS date))",
    ),
    "QE-OCT": (
        "cast(date_trunc('quarter', d + INTERVAL 2 MONTH) - INTERVAL 2 MONTH AS date)", "INTERVAL 3 MONTH",
        "last_day(cast(cast(b AS date) + INTERVAL 2 MONTH AS date))",
    ),
    "YE-JUN": (
        "cast(date_trunc('year', d + INTERVAL 6 MONTH) - INTERVAL 6 MONTH AS date)", "INTERVAL 1 YEAR",
        "last_day(cast(cast(b AS date) + INTERVAL 11 MONTH AS date))",
    ),
    "B": ("cast(d AS date) - cast(greatest(isodow(d) - 5, 0) AS integer)", "INTERVAL 1 DAY", "cast(b AS date)", "isodow(b) < 6"),
}


def series_sql(source: str, freq: str = "D", threshold: float = 1.5) -> str:
    """CTEs ``dense`` and ``scored`` over rows (k, d, v)."""
    base, step, label, *only = PERIODS[freq]
    trail = "OVER (PARTITION BY k ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return f"""
src AS ({source}),
based AS (SELECT k, {base} AS b, v FROM src WHERE d IS NOT NULL AND v IS NOT NULL),
agg AS (SELECT k, b, sum(v) AS revenue, count(*) AS n FROM based GROUP BY k, b),
spine AS (SELECT k, unnest(generate_series(lo, hi, {step})) AS b
          FROM (SELECT k, min(b) AS lo, max(b) AS hi FROM agg GROUP BY k)),
dense AS (SELECT s.k, s.b, coalesce(a.revenue, 0) AS revenue, coalesce(a.n, 0) AS n
          FROM (SELECT * FROM spine{f" WHERE {only[0]}" if only else ""}) s LEFT JOIN agg a ON s.k = a.k AND s.b = a.b),
windowed AS (SELECT k, b, {label} AS period, revenue, n,
    avg(revenue) OVER (PARTITION BY k) AS m, stddev_pop(revenue) OVER (PARTITION BY k) AS sd,
    count(*) OVER (PARTITION BY k) AS np, avg(revenue) {trail} AS rm, stddev_pop(revenue) {trail} AS rs,
    count(*) {trail} AS rn, lag(revenue) OVER (PARTITION BY k ORDER BY b) AS prev,
    row_number() OVER (PARTITION BY k ORDER BY b) AS i,
    row_number() OVER (PARTITION BY k ORDER BY b DESC) AS back FROM dense),
measured AS (SELECT *, CASE WHEN np >= 3 AND sd > 0 THEN abs(revenue - m) / sd END AS z,
    CASE WHEN np >= 3 AND sd > 0 THEN
         CASE WHEN rn >= 2 AND rs > 0 THEN abs(revenue - rm) / rs ELSE 0 END END AS dev FROM windowed),
scored AS (SELECT *, coalesce(z > {threshold} OR dev > {threshold}, false) AS hit FROM measured)
"""


def kpi_sql(source: str, freq: str = "D") -> str:
    """CTE ``kpi`` with one row per k, after the series CTEs."""
    return series_sql(source, freq) + """,
kpi AS (SELECT k, round(sum(revenue), 2) AS total_revenue,
    round(coalesce((max(revenue) FILTER (back = 1) - max(revenue) FILTER (back = 2))
          / nullif(max(revenue) FILTER (back = 2), 0) * 100, 0), 2) AS growth_rate,
    round(sum(revenue) / sum(n), 2) AS average_revenue,
    count(*) FILTER (hit) AS anomaly_count, cast(sum(n) AS bigint) AS row_count,
    count(*) AS period_count, max(period) AS latest_period,
    max(period) FILTER (back = 2) AS previous_period FROM scored GROUP BY k)
"""
