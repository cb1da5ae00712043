"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustkpi.functions import dates, numbers
from trustkpi.operators.clean import COPIES, POSITION
from trustkpi.operators.column_state import column_state, long_rows, with_distinct
from trustkpi.operators.keyed import Keys, attach, cols, data_columns


def profile(cleaned: DataFrame, keys: Keys = (), order: DataFrame | None = None) -> DataFrame:
    """(keys, column, pos, rows, non_null, distinct, date_ratio, number_ratio).

    One pass over the cells (see ``column_state``); a second one, over digests, only for columns with
    more distinct values than a sketch counts. Numeric columns are no date candidates. Columns without
    any value are left out. ``order`` (keys, column, pos) gives places that differ between datasets.
    """
    columns = data_columns(cleaned, keys, POSITION, COPIES)
    cells = long_rows(cleaned, keys, columns)
    v = F.col("value")
    parsed = cells.select(
        "*", numbers.parse_number(v).isNotNull().alias("is_number"), numbers.looks_number(v).alias("strict")
    ).withColumn("is_date", ~F.col("strict") & dates.parse_date(v).isNotNull())
    state = column_state(
        parsed, keys,
        [
            F.count_if("is_date").alias("_dates"), F.count_if("is_number").alias("_numbers"),
            F.coalesce(F.bool_and("strict"), F.lit(False)).alias("_all_numeric"),
        ],
    )
    counts = with_distinct(state, lambda names: long_rows(cleaned, keys, names), keys, F.lit(True)).where("non_null > 0")
    if order is None:
        counts = counts.withColumn("pos", F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")) - 1)
    else:
        counts = attach(counts, order, [*keys, "column"])
    return counts.select(
        *cols(keys),
        "column",
        F.col("pos").cast("int").alias("pos"),
        "rows",
        "non_null",
        "distinct",
        F.when(F.col("_all_numeric"), 0.0).otherwise(F.col("_dates") / F.col("rows")).alias("date_ratio"),
        (F.col("_numbers") / F.col("rows")).alias("number_ratio"),
    )


def profile_report(cleaned: DataFrame, keys: Keys = (), order: DataFrame | None = None) -> DataFrame:
    """Semantic type, ratios to three decimals and three sample values per column."""
    columns = data_columns(cleaned, keys, POSITION, COPIES)
    base = profile(cleaned, keys, order)
    kind = (
        F.when(F.col("date_ratio") >= 0.6, "date").when(F.col("number_ratio") >= 0.7, "number").otherwise("string")
    )
    report = base.select(
        *cols(keys),
        "column",
        "pos",
        kind.alias("semantic_type"),
        F.round(F.col("non_null") / F.col("rows"), 3).alias("non_null_ratio"),
        F.round(F.col("distinct") / F.greatest("non_null", F.lit(1)), 3).alias("distinct_ratio"),
    )
    return attach(report, samples(cleaned, keys, columns), [*keys, "column"])


def samples(cleaned: DataFrame, keys: Keys, columns: list[str], size: int = 3) -> DataFrame:
    """First ``size`` values of each column by row position; each task sends no more than that many."""
    pairs = F.array(
        *[
            F.when(
                F.col(f"`{c}`").isNotNull(),
                F.struct(
                    F.lit(c).alias("column"), F.col(POSITION).alias("p"), F.col(f"`{c}`").alias("value")
                ),
            )
            for c in columns
        ]
    )
    cells = cleaned.select(*cols(keys), F.inline(F.array_compact(pairs)))
    rank = F.row_number().over(Window.partitionBy(*cols(keys), "column").orderBy("p", "value"))
    first = cells.withColumn("_rank", rank).where(F.col("_rank") <= size)
    listed = F.sort_array(F.collect_list(F.struct("_rank", "value")))
    return first.groupBy(*cols(keys), "column").agg(listed["value"].alias("sample_values"))
