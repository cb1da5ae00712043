"""KPIs over canonical rows (``date``, ``revenue`` and optional dimensions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions.periods import period
from trustkpi.functions.text import card_text
from trustkpi.operators import series as ts
from trustkpi.operators.keyed import Keys, attach, cols
from trustkpi.operators.ranking import exact_median


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"the rows lack the columns {', '.join(missing)}")


def required_rows(df: DataFrame) -> DataFrame:
    """Rows that have both a date and a revenue."""
    require_columns(df, "date", "revenue")
    return df.na.drop(subset=["date", "revenue"])


def growth(current: Column, previous: Column) -> Column:
    """Percent change; 0 without a previous period or when it is 0."""
    return F.coalesce(F.try_divide(current - previous, previous) * 100, F.lit(0.0))


def kpis(
    df: DataFrame,
    freq: str = "D",
    keys: Keys = (),
    threshold: float = fixed.ANOMALY_THRESHOLD,
    width: int = fixed.ROLLING_WINDOW,
) -> DataFrame:
    """One row per key: totals, growth, anomaly count, row and period counts."""
    require_columns(df, "date", "revenue")
    return summarize(ts.scored_series(df, freq, keys, threshold, width), freq, keys)


def summarize(scored: DataFrame, freq: str, keys: Keys = ()) -> DataFrame:
    p = period(freq)
    current, previous = ts.last_two(p)
    total, n = F.sum("revenue"), F.sum("rows")
    out = scored.groupBy(*cols(keys)).agg(
        F.round(total, 2).alias("total_revenue"),
        F.round(growth(current, previous), 2).alias("growth_rate"),
        F.round(total / n, 2).alias("average_revenue"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        n.alias("row_count"),
        F.count(F.lit(1)).alias("period_count"),
        p.label(F.max("_last")).alias("latest_period"),
        F.when(F.count(F.lit(1)) > 1, p.label(F.max("_last") - p.multiple)).alias("previous_period"),
    )
    return out.where(F.col("period_count") > 0)


def anomalies(
    df: DataFrame,
    freq: str = "D",
    keys: Keys = (),
    threshold: float = fixed.ANOMALY_THRESHOLD,
    width: int = fixed.ROLLING_WINDOW,
) -> DataFrame:
    """Anomalous periods in long form, one row each."""
    scored = ts.scored_series(df, freq, keys, threshold, width).where("is_anomaly")
    return scored.select(
        *cols(keys),
        "period",
        F.round("revenue", 2).alias("revenue"),
        F.round("z_score", 4).alias("z_score"),
        F.round("rolling_dev", 4).alias("rolling_dev"),
    )


def kpi_report(df: DataFrame, freq: str = "D", keys: Keys = (), **rule) -> DataFrame:
    """KPI row with nested anomalies and series.

    Arrays hold one element per calendar period, so only day or longer periods
    are allowed here; finer ones stay in long form (``scored_series``).
    """
    if period(freq).sub_day:
        raise ValueError("nested output needs a period of a day or more; use scored_series")
    scored = ts.scored_series(df, freq, keys, **rule)
    day = F.date_format("period", "yyyy-MM-dd")
    point = F.struct(day.alias("date"), F.round("revenue", 2).alias("revenue"))
    hit = F.when(F.col("is_anomaly"), F.struct(day.alias("date"), F.round("z_score", 4).alias("z")))
    nested = scored.groupBy(*cols(keys)).agg(
        F.array_sort(F.collect_list(hit)).alias("_hits"),
        F.array_sort(F.collect_list(point)).alias("series"),
    )
    head = summarize(scored, freq, keys)
    out = attach(head, nested, keys)
    return out.select(
        *cols(keys),
        "total_revenue",
        "growth_rate",
        "average_revenue",
        F.struct(
            F.size("_hits").alias("count"),
            F.col("_hits.date").alias("dates"),
            F.map_from_entries("_hits").alias("z_scores"),
        ).alias("anomalies"),
        "series",
        "row_count",
        "period_count",
    )


def trend_direction(growth_rate: Column) -> Column:
    return F.when(growth_rate > 0, "upward").when(growth_rate < 0, "downward").otherwise("stable")


def last_point_delta(df: DataFrame, freq: str = "D", keys: Keys = ()) -> DataFrame:
    """Change of the last point against the one before, one decimal; NULL when that is 0."""
    p = period(freq)
    current, previous = ts.last_two(p)
    scored = ts.scored_series(df, freq, keys)
    return scored.groupBy(*cols(keys)).agg(
        F.round(current, 2).alias("latest_revenue"),
        F.round(F.try_divide(current - previous, previous) * 100, 1).alias("delta_percent"),
    )


def kpi_cards(kpi: DataFrame, anomaly_rows: DataFrame, keys: Keys = ()) -> DataFrame:
    """Four display cards per key: (label, value, kind, caption, trend_icon, text)."""
    days = anomaly_rows.groupBy(*cols(keys)).agg(
        F.array_sort(F.collect_list(F.date_format("period", "yyyy-MM-dd"))).alias("_days")
    )
    wide = attach(kpi, days, keys)
    g = F.coalesce(F.col("growth_rate"), F.lit(0.0))
    joined = F.array_join("_days", " / ")
    previous = F.coalesce(F.date_format("previous_period", "yyyy-MM-dd"), F.lit("the prior period"))
    latest = F.coalesce(F.date_format("latest_period", "yyyy-MM-dd"), F.lit("the latest period"))

    def card(pos, label, value, kind, caption, icon):
        return F.struct(
            F.lit(pos).alias("pos"), F.lit(label).alias("label"), value.cast("double").alias("value"),
            F.lit(kind).alias("kind"), caption.alias("caption"), icon.alias("trend_icon"),
        )

    cards = F.array(
        card(1, "Total Revenue", F.col("total_revenue"), "currency",
             F.lit("Commercial output captured across the uploaded dataset."), trend_direction(g)),
        card(2, "Growth Rate", g, "percent",
             F.concat(F.lit("Measured from "), previous, F.lit(" to "), latest, F.lit(".")),
             F.when(g >= 0, "upward").otherwise("downward")),
        card(3, "Average Revenue", F.col("average_revenue"), "currency",
             F.lit("Average revenue per normalized row in the source file."), F.lit("stable")),
        card(4, "Anomaly Periods", F.col("anomaly_count"), "count",
             F.when(F.coalesce(F.size("_days"), F.lit(0)) > 0, joined).otherwise(
                 "No anomaly periods were detected."),
             F.when(F.col("anomaly_count") > 0, "downward").otherwise("upward")),
    )
    return (
        wide.select(*cols(keys), F.inline(cards))
        .withColumn("text", card_text("value", "kind"))
    )


def median_revenue(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Exact median and row count per key."""
    known = required_rows(df)
    counts = known.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("record_count"))
    middle = exact_median(known, keys, F.col("revenue"), "median_revenue")
    return attach(counts, middle, keys)


def breakdown(df: DataFrame, dimension: str, keys: Keys = ()) -> DataFrame:
    """Revenue of every value of a dimension: (keys, label, value)."""
    label = F.coalesce(F.col(f"`{dimension}`").cast("string"), F.lit("Unknown"))
    return (
        required_rows(df)
        .groupBy(*cols(keys), F.col(f"`{dimension}`"))
        .agg(F.sum("revenue").alias("value"))
        .select(*cols(keys), label.alias("label"), "value")
    )


def top_dimension(df: DataFrame, dimension: str, keys: Keys = ()) -> DataFrame:
    """Strongest value of a dimension per key; ties go to the first in text order."""
    if dimension not in df.columns:
        return df.groupBy(*cols(keys)).agg(
            F.lit("N/A").alias(f"top_{dimension}"), F.lit(None).cast("double").alias("value")
        )
    sums = breakdown(df, dimension, keys)
    # The largest value wins, then the first label; missing sums never do.
    best = sums.where("value IS NOT NULL").groupBy(*cols(keys)).agg(F.min(F.struct((-F.col("value")).alias("v"), "label")).alias("b"))
    return best.select(*cols(keys), F.col("b.label").alias(f"top_{dimension}"), (-F.col("b.v")).alias("value"))


def insight_flags(df: DataFrame, dimension: str, keys: Keys = ()) -> DataFrame:
    top = top_dimension(df, dimension, keys)
    name = F.col(f"top_{dimension}")
    text = F.when(name != "N/A", F.concat(name, F.lit(f" is the strongest {dimension} by revenue.")))
    return top.select(*cols(keys), text.alias("flag")).where("flag IS NOT NULL")


def forecast(df: DataFrame, freq: str = "W", keys: Keys = ()) -> DataFrame:
    """Least-squares line over period number 0..n-1, evaluated at n."""
    p = period(freq)
    dense = ts.fill_gaps(ts.bucket(df, p, keys), p, keys)
    first = dense.groupBy(*cols(keys)).agg(F.min("_ix").alias("_first"))
    # Gap-free series: the period number is plain arithmetic, no ranking.
    numbered = attach(dense, first, keys).withColumn(
        "_i", ((F.col("_ix") - F.col("_first")) / p.multiple).cast("double")
    )
    n = F.count(F.lit(1))
    slope = F.try_divide(F.covar_pop("revenue", "_i"), F.var_pop("_i"))
    line = F.avg("revenue") + slope * (n - F.avg("_i"))
    return numbered.groupBy(*cols(keys)).agg(
        n.alias("period_count"), F.round(line, 2).alias("forecast_next_period_revenue")
    )
