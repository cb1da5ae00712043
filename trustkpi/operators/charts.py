"""Chart tables: (keys, chart_id, type, title, pos, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions.periods import period
from trustkpi.functions.text import currency_text, fill
from trustkpi.operators import series as ts
from trustkpi.operators.keyed import Keys, attach, cols
from trustkpi.operators.kpi import required_rows
from trustkpi.session import stage

DAY = period("D")


def _points(df: DataFrame, keys: Keys, chart_id: str, kind: str, title: str) -> DataFrame:
    return df.select(
        *cols(keys),
        F.lit(chart_id).alias("chart_id"),
        F.lit(kind).alias("type"),
        F.lit(title).alias("title"),
        "pos",
        "x",
        "y",
    )


def _timeline(dense: DataFrame, keys: Keys) -> DataFrame:
    first = dense.groupBy(*cols(keys)).agg(F.min("_ix").alias("_first"))
    # Days are gap-free, so a point's position is a subtraction.
    return attach(dense, first, keys).select(
        *cols(keys),
        (F.col("_ix") - F.col("_first") + 1).cast("int").alias("pos"),
        F.date_format(DAY.label(F.col("_ix")), "yyyy-MM-dd").alias("x"),
        F.col("revenue").alias("y"),
    )


def line_chart(df: DataFrame, y_field: str = "revenue", keys: Keys = ()) -> DataFrame:
    """Dense daily sum of ``y_field``."""
    rows = required_rows(df).withColumn("_y", F.coalesce(F.col(f"`{y_field}`").cast("double"), F.lit(0.0)))
    dense = ts.fill_gaps(ts.bucket(rows, DAY, keys, value="_y"), DAY, keys)
    return _points(_timeline(dense, keys), keys, "revenue-trend", "line", "Revenue Trend")


def top_rows(sums: DataFrame, keys: Keys, value: str, label: str, limit: int) -> DataFrame:
    """The ``limit`` highest rows per key with their ``pos``; ties in label order."""
    order = [F.col(value).desc(), F.col(label).asc_nulls_last()]
    if not keys:
        # Each task keeps its own best rows, so only those travel.
        sums = sums.orderBy(*order).limit(limit)
    ranked = sums.withColumn("pos", F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(*order)))
    return ranked.where(F.col("pos") <= limit)


def ranked_chart(
    df: DataFrame,
    field: str,
    kind: str = "bar",
    y_field: str = "revenue",
    keys: Keys = (),
    limit: int = fixed.BREAKDOWN_LIMIT,
) -> DataFrame:
    """Top values of a dimension by summed ``y_field``; a NULL value counts as a group."""
    if kind not in ("bar", "pie"):
        raise ValueError(f"no such chart type: {kind}")
    if field not in df.columns:
        raise ValueError(f"the rows have no column {field} to group by")
    sums = (
        required_rows(df)
        .groupBy(*cols(keys), F.col(f"`{field}`").alias("_label"))
        .agg(F.coalesce(F.sum(F.col(f"`{y_field}`")), F.lit(0.0)).alias("y"))
    )
    top = top_rows(sums, keys, "y", "_label", limit).withColumn(
        "x", F.coalesce(F.col("_label").cast("string"), F.lit("Unknown"))
    )
    title = f"{field.title()} Revenue" + (" Mix" if kind == "pie" else "")
    return _points(top, keys, f"{field}-{kind}", kind, title)


def with_share(points: DataFrame, keys: Keys = ()) -> DataFrame:
    """Share of each point among the chart's points (at most the chart's limit)."""
    whole = F.sum("y").over(Window.partitionBy(*cols(keys), "chart_id"))
    return points.withColumn("share", F.try_divide(F.col("y"), whole))


def chart(
    df: DataFrame,
    chart_type: str = "line",
    x_field: str | None = None,
    y_field: str = "revenue",
    color_field: str | None = None,
    keys: Keys = (),
) -> DataFrame:
    kind = chart_type.lower()
    if y_field not in df.columns:
        raise ValueError(f"the rows have no column {y_field} to add up")
    if kind == "line":
        return line_chart(df, y_field, keys)
    field = x_field or color_field
    if not field:
        raise ValueError(f"a {kind} chart needs x_field or color_field")
    return ranked_chart(df, field, kind, y_field, keys)


def chart_specs(df: DataFrame, max_charts: int = 3, keys: Keys = ()) -> DataFrame:
    """Recommended charts: (keys, pos, chart_type, x_field, y_field).

    "At least two distinct values" is ``min < max``, which needs no distinct.
    """
    fields = [f for f in ("category", "region") if f in df.columns]
    varied = required_rows(df).groupBy(*cols(keys)).agg(
        F.count(F.lit(1)).alias("_n"),
        *[(F.min(f) < F.max(f)).alias(f"_{f}") for f in fields],
    )

    def spec(kind: str, field: str) -> Column:
        return F.struct(
            F.lit(kind).alias("chart_type"), F.lit(field).alias("x_field"), F.lit("revenue").alias("y_field")
        )

    bars = [F.when(F.col(f"_{f}"), spec("bar", f)) for f in fields]
    specs = F.slice(F.array_compact(F.array(spec("line", "date"), *bars)), 1, max_charts)
    listed = varied.where("_n > 0").select(*cols(keys), F.posexplode(specs).alias("p", "s"))
    return listed.select(*cols(keys), (F.col("p") + 1).alias("pos"), "s.*")


def chart_set(
    df: DataFrame, max_charts: int = 3, keys: Keys = (), limit: int = fixed.BREAKDOWN_LIMIT
) -> DataFrame:
    """Line chart plus a bar per dimension with at least two values.

    Every row contributes once to its day and once to each dimension in a
    single aggregation; days and labels are then cut from that small table.
    """
    fields = [f for f in ("category", "region") if f in df.columns]
    rows = required_rows(df)
    none_text, none_ix = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    shares = [F.struct(F.lit("date").alias("field"), none_text.alias("label"), DAY.index(F.col("date")).alias("_ix"))]
    shares += [
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label"), none_ix.alias("_ix"))
        for f in fields
    ]
    sums = (
        rows.select(*cols(keys), F.col("revenue").cast("double").alias("revenue"), F.inline(F.array(*shares)))
        .groupBy(*cols(keys), "field", "label", "_ix")
        .agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("rows"))
    )
    sums = stage(sums, "chart-sums")
    days = sums.where("field = 'date'").select(*cols(keys), "_ix", "revenue", "rows")
    out = _points(
        _timeline(ts.fill_gaps(days, DAY, keys), keys), keys, "revenue-trend", "line", "Revenue Trend"
    ).withColumn("chart_pos", F.lit(1))
    labels = sums.where("field <> 'date'")
    scope = [*keys, "field"]
    varied = labels.groupBy(*cols(scope)).agg((F.count("label") >= 2).alias("_varied"))
    position = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field")) if fields else F.lit(1)
    kept = varied.where("_varied").select(*cols(scope), position.alias("_at"))
    earlier = kept.groupBy(*cols(keys)).agg(F.min("_at").alias("_first_at"))
    placed = attach(kept, earlier, keys).withColumn(
        "chart_pos", F.when(F.col("_at") == F.col("_first_at"), 2).otherwise(3)
    )
    placed = placed.select(*cols(scope), "chart_pos").where(F.col("chart_pos") <= max_charts)
    bars = attach(labels, placed, scope).where("chart_pos IS NOT NULL")
    bars = top_rows(bars, scope, "revenue", "label", limit)
    bars = bars.select(
        *cols(keys),
        F.concat("field", F.lit("-bar")).alias("chart_id"),
        F.lit("bar").alias("type"),
        F.concat(F.initcap("field"), F.lit(" Revenue")).alias("title"),
        "pos",
        F.coalesce("label", F.lit("Unknown")).alias("x"),
        F.col("revenue").alias("y"),
        "chart_pos",
    )
    return out.unionByName(bars)


def chart_insights(points: DataFrame, keys: Keys = ()) -> DataFrame:
    """First, last and leading point of every chart: (keys, chart_pos, chart_id, fact)."""
    ends = points.groupBy(*cols(keys), "chart_pos", "chart_id", "type", "title").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("x", "y"), "pos").alias("head"),
        F.max_by(F.struct("x", "y"), "pos").alias("tail"),
    )
    line = fill(
        fixed.CHART_FACT_LINE, first=F.col("head.x"), last=F.col("tail.x"), value=currency_text("tail.y")
    )
    ranked = fill(
        fixed.CHART_FACT_RANKED, title=F.lower("title"), leader=F.col("head.x"), value=currency_text("head.y")
    )
    fact = F.when(F.col("type") != "line", ranked).when(F.col("n") >= 2, line)
    return ends.select(*cols(keys), "chart_pos", "chart_id", fact.alias("fact"))
