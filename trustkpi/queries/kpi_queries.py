"""KPI and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustkpi.operators import kpi, series
from trustkpi.queries import inputs as src

SEG = ["segment"]


def _events(spark, folder):
    return src.table(spark, folder, "events").selectExpr(
        "ts AS date", "value AS revenue", "event_type AS segment"
    )


EVENTS_SQL = "SELECT ts AS d, value AS v, event_type AS k FROM events"
ALL_ORDERS_SQL = "SELECT 0 AS k, d, v FROM (" + src.ORDERS_SQL + ")"
ALL_EVENTS_SQL = "SELECT 0 AS k, ts AS d, value AS v FROM events"


def _series(freq, rows=src.orders):
    def run(spark, folder):
        return series.period_series(rows(spark, folder), freq).select(
            "period", F.round("revenue", 2).alias("revenue"), "rows"
        )

    return run


def _series_sql(freq, source=ALL_ORDERS_SQL):
    return (
        f"WITH {src.series_sql(source, freq)} "
        "SELECT period, round(revenue, 2) AS revenue, cast(n AS bigint) AS rows FROM scored"
    )


def flagship(spark, folder):
    """Monthly orders: dense series, growth against the month before, z-score, anomaly flag."""
    scored = series.scored_series(src.orders(spark, folder), "ME", SEG)
    return scored.select(
        "segment", "period", F.round("revenue", 2).alias("revenue"), "rows",
        F.round(kpi.growth(F.col("revenue"), F.col("previous")), 2).alias("growth_rate"),
        F.round("z_score", 4).alias("z_score"), F.round("rolling_dev", 4).alias("rolling_dev"), "is_anomaly",
    )


FLAGSHIP_SQL = f"""WITH {src.series_sql(src.ORDERS_SQL, 'ME')}
SELECT k AS segment, period, round(revenue, 2) AS revenue, cast(n AS bigint) AS rows,
       round(coalesce((revenue - prev) / nullif(prev, 0) * 100, 0), 2) AS growth_rate,
       round(z, 4) AS z_score, round(dev, 4) AS rolling_dev, hit AS is_anomaly FROM scored"""


def _kpis(freq, keys, rows=src.orders):
    def run(spark, folder):
        return kpi.kpis(rows(spark, folder), freq, keys)

    return run


_KPI_COLUMNS = (
    "total_revenue, growth_rate, average_revenue, anomaly_count, row_count, period_count, "
    "latest_period, previous_period"
)


def _kpis_sql(freq, source, key=None):
    head = f"k AS {key}, " if key else ""
    return f"WITH {src.kpi_sql(source, freq)} SELECT {head}{_KPI_COLUMNS} FROM kpi"


def growth(spark, folder):
    return kpi.kpis(src.orders(spark, folder), "QE", SEG).select(
        "segment", "growth_rate", kpi.trend_direction(F.col("growth_rate")).alias("trend_direction")
    )


def zscores(spark, folder):
    scored = series.scored_series(src.orders(spark, folder), "W", SEG)
    return scored.select("segment", "period", F.round("z_score", 4).alias("z_score"))


def rolling_deviation(spark, folder):
    scored = series.scored_series(src.orders(spark, folder), "D")
    return scored.select("period", F.round("rolling_dev", 4).alias("rolling_dev"))


def anomaly_rows(spark, folder):
    return kpi.anomalies(_events(spark, folder), "D", SEG)


def kpi_nested(spark, folder):
    out = kpi.kpi_report(_events(spark, folder), "D", SEG)
    return out.select(
        "segment", "total_revenue", "growth_rate", "average_revenue",
        F.col("anomalies.count").cast("bigint").alias("anomaly_count"),
        F.array_join("anomalies.dates", ",").alias("anomaly_dates"),
        F.array_join(
            F.transform(F.array_sort(F.map_entries("anomalies.z_scores")),
                        lambda e: F.format_string("%s:%.4f", e["key"], e["value"])), ","
        ).alias("z_scores"),
        F.size("series").cast("bigint").alias("points"),
        F.col("series")[0]["date"].alias("first_day"),
        "row_count", "period_count",
    )


KPI_NESTED_SQL = f"""WITH {src.kpi_sql(EVENTS_SQL, 'D')}
SELECT k AS segment, max(kpi.total_revenue) AS total_revenue, max(growth_rate) AS growth_rate,
  max(average_revenue) AS average_revenue, max(anomaly_count) AS anomaly_count,
  coalesce(string_agg(strftime(period, '%Y-%m-%d'), ',' ORDER BY period) FILTER (hit), '') AS anomaly_dates,
  coalesce(string_agg(strftime(period, '%Y-%m-%d') || ':' || printf('%.4f', round(z, 4)), ',' ORDER BY period)
           FILTER (hit), '') AS z_scores,
  count(*) AS points, strftime(min(period), '%Y-%m-%d') AS first_day,
  max(row_count) AS row_count, max(period_count) AS period_count
FROM scored JOIN kpi USING (k) GROUP BY k"""


def cards(spark, folder):
    rows = src.orders(spark, folder)
    return kpi.kpi_cards(kpi.kpis(rows, "YE", SEG), kpi.anomalies(rows, "YE", SEG), SEG)


CARDS_SQL = f"""WITH {src.kpi_sql(src.ORDERS_SQL, 'YE')},
days AS (SELECT k, string_agg(strftime(period, '%Y-%m-%d'), ' / ' ORDER BY period) AS joined
         FROM scored WHERE hit GROUP BY k),
base AS (SELECT kpi.*, joined, coalesce(strftime(previous_period, '%Y-%m-%d'), 'the prior period') AS p,
         strftime(latest_period, '%Y-%m-%d') AS l FROM kpi LEFT JOIN days USING (k)),
cards AS (
  SELECT k AS segment, 1 AS pos, 'Total Revenue' AS label, total_revenue AS value, 'currency' AS kind,
    'Commercial output captured across the uploaded dataset.' AS caption,
    CASE WHEN growth_rate > 0 THEN 'upward' WHEN growth_rate < 0 THEN 'downward' ELSE 'stable' END AS trend_icon
  FROM base
  UNION ALL SELECT k, 2, 'Growth Rate', growth_rate, 'percent', 'Measured from ' || p || ' to ' || l || '.',
    CASE WHEN growth_rate >= 0 THEN 'upward' ELSE 'downward' END FROM base
  UNION ALL SELECT k, 3, 'Average Revenue', average_revenue, 'currency',
    'Average revenue per normalized row in the source file.', 'stable' FROM base
  UNION ALL SELECT k, 4, 'Anomaly Periods', cast(anomaly_count AS double), 'count',
    coalesce(joined, 'No anomaly periods were detected.'),
    CASE WHEN anomaly_count > 0 THEN 'downward' ELSE 'upward' END FROM base)
SELECT *, CASE kind WHEN 'currency' THEN (CASE WHEN round(value) < 0 THEN '-$' ELSE '$' END)
      || format('{{:,.0f}}', abs(round(value)))
    WHEN 'percent' THEN printf('%.1f', CASE WHEN (abs(value) * 4) % 4 = 1 THEN value + sign(value) * 0.01 ELSE value END) || '%' ELSE format('{{:,.0f}}', value) END AS text FROM cards"""


def last_delta(spark, folder):
    return kpi.last_point_delta(src.orders(spark, folder), "ME", SEG)


LAST_DELTA_SQL = f"""WITH {src.series_sql(src.ORDERS_SQL, 'ME')}
SELECT k AS segment, round(revenue, 2) AS latest_revenue,
       round((revenue - prev) / nullif(prev, 0) * 100, 1) AS delta_percent FROM scored WHERE back = 1"""


def median(spark, folder):
    return kpi.median_revenue(src.orders(spark, folder), SEG)


def median_all(spark, folder):
    rows = src.table(spark, folder, "lineitem").selectExpr("l_shipdate AS date", "l_extendedprice AS revenue")
    return kpi.median_revenue(rows).select("record_count", F.round("median_revenue", 4).alias("median_revenue"))


def breakdown(spark, folder):
    rows = src.sales(spark, folder)
    return kpi.breakdown(rows, "category", ["region"]).select(
        "region", "label", F.round("value", 2).alias("value")
    )


def top_dimension(spark, folder):
    return kpi.top_dimension(src.sales(spark, folder), "region", SEG).select(
        "segment", "top_region", F.round("value", 2).alias("value")
    )


def flags(spark, folder):
    return kpi.insight_flags(src.sales(spark, folder), "category", SEG)


_TOP_SQL = """WITH s AS ({source}), g AS (SELECT k, {dim} AS x, sum(v) AS y FROM s GROUP BY k, {dim}),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC, x) AS rn FROM g) """


def forecast(spark, folder):
    return kpi.forecast(src.orders(spark, folder), "W", SEG)


FORECAST_SQL = f"""WITH {src.series_sql(src.ORDERS_SQL, 'W')}
SELECT k AS segment, count(*) AS period_count,
  round(regr_slope(revenue, i - 1) * count(*) + regr_intercept(revenue, i - 1), 2) AS forecast_next_period_revenue
FROM scored GROUP BY k"""


def required(spark, folder):
    rows = src.orders(spark, folder).selectExpr(
        "id", "CASE WHEN id % 11 = 3 THEN NULL ELSE date END AS date",
        "CASE WHEN id % 13 = 4 THEN NULL ELSE revenue END AS revenue",
    )
    return kpi.required_rows(rows).selectExpr("id", "cast(date AS date) AS date", "revenue")


QUERIES = {
    "monthly_kpi_series": (flagship, FLAGSHIP_SQL),
    "kpi_totals": (_kpis("D", []), _kpis_sql("D", ALL_ORDERS_SQL)),
    "kpis_weekly": (_kpis("W", []), _kpis_sql("W", ALL_ORDERS_SQL)),
    "kpis_by_segment": (_kpis("D", SEG), _kpis_sql("D", src.ORDERS_SQL, "segment")),
    "kpis_by_event_type": (_kpis("D", SEG, _events), _kpis_sql("D", EVENTS_SQL, "segment")),
    "kpi_report_nested": (kpi_nested, KPI_NESTED_SQL),
    "series_daily": (_series("D"), _series_sql("D")),
    "series_weekly": (_series("W"), _series_sql("W")),
    "series_month_end": (_series("ME"), _series_sql("ME")),
    "series_month_start": (_series("MS"), _series_sql("MS")),
    "series_quarterly": (_series("QE"), _series_sql("QE")),
    "series_yearly": (_series("YE"), _series_sql("YE")),
    "series_seven_day": (_series("7D"), _series_sql("7D")),
    "series_two_weeks": (_series("2W"), _series_sql("2W")),
    "series_two_months": (_series("2ME"), _series_sql("2ME")),
    "series_quarter_october": (_series("QE-OCT"), _series_sql("QE-OCT")),
    "series_year_june": (_series("YE-JUN"), _series_sql("YE-JUN")),
    "series_workdays": (_series("B"), _series_sql("B")),
    "series_hourly": (
        lambda spark, folder: _series("h", _events)(spark, folder).withColumn("period", F.col("period").cast("string")),
        f"SELECT * REPLACE (cast(period AS varchar) AS period) FROM ({_series_sql('h', ALL_EVENTS_SQL)})",
    ),
    "required_rows": (
        required,
        "SELECT o_orderkey AS id, cast(o_orderdate AS date) AS date, o_totalprice AS revenue FROM orders "
        "WHERE o_orderkey % 11 <> 3 AND o_orderkey % 13 <> 4",
    ),
    "growth_and_trend": (
        growth,
        f"WITH {src.kpi_sql(src.ORDERS_SQL, 'QE')} SELECT k AS segment, growth_rate, CASE WHEN growth_rate > 0 "
        "THEN 'upward' WHEN growth_rate < 0 THEN 'downward' ELSE 'stable' END AS trend_direction FROM kpi",
    ),
    "zscore_weekly": (
        zscores,
        f"WITH {src.series_sql(src.ORDERS_SQL, 'W')} SELECT k AS segment, period, round(z, 4) AS z_score FROM scored",
    ),
    "rolling_deviation": (
        rolling_deviation,
        f"WITH {src.series_sql(ALL_ORDERS_SQL, 'D')} SELECT period, round(dev, 4) AS rolling_dev FROM scored",
    ),
    "anomalies": (
        anomaly_rows,
        f"WITH {src.series_sql(EVENTS_SQL, 'D')} SELECT k AS segment, period, round(revenue, 2) AS revenue, "
        "round(z, 4) AS z_score, round(dev, 4) AS rolling_dev FROM scored WHERE hit",
    ),
    "kpi_cards": (cards, CARDS_SQL),
    "last_point_delta": (last_delta, LAST_DELTA_SQL),
    "median_by_segment": (
        median,
        "SELECT o_orderpriority AS segment, count(*) AS record_count, median(o_totalprice) AS median_revenue "
        "FROM orders GROUP BY 1",
    ),
    "median_all_lines": (
        median_all,
        "SELECT count(*) AS record_count, round(median(l_extendedprice), 4) AS median_revenue FROM lineitem",
    ),
    "breakdown_full": (
        breakdown,
        f"SELECT region, coalesce(category, 'Unknown') AS label, round(sum(v), 2) AS value "
        f"FROM ({src.SALES_SQL}) GROUP BY region, category",
    ),
    "top_dimension": (
        top_dimension,
        _TOP_SQL.format(source=src.SALES_SQL, dim="region")
        + "SELECT k AS segment, x AS top_region, round(y, 2) AS value FROM r WHERE rn = 1",
    ),
    "insight_flags": (
        flags,
        _TOP_SQL.format(source=src.SALES_SQL, dim="category")
        + "SELECT k AS segment, x || ' is the strongest category by revenue.' AS flag FROM r WHERE rn = 1",
    ),
    "forecast_next_period": (forecast, FORECAST_SQL),
}
