"""Periods against pandas, and the spine of long series."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustkpi.functions.periods import period
from trustkpi.operators import series

DAYS = ["2023-10-31", "2023-11-01 23:30", "2024-01-05", "2024-01-06", "2024-01-07", "2024-02-29", "2024-03-31 12:00", "2024-07-15", "2025-01-01"]
FREQS = [
    "D", "3D", "B", "2B", "W", "2W", "3W-TUE", "W-SAT", "ME", "2ME", "5ME", "MS", "2MS", "QE", "QE-OCT", "2QE-NOV", "QS", "QS-FEB",
    "3QS-DEC", "YE", "YE-JUN", "2YE-MAR", "YS", "YS-JUL", "2YS-APR", "6h", "h",
]


@pytest.mark.parametrize("freq", FREQS)
@pytest.mark.parametrize("first", [0, 2, 3])
def test_series_equal_pandas(spark, freq, first):
    days = DAYS[first:] if freq != "h" else DAYS[first : first + 2]
    rows = pd.DataFrame({"date": pd.to_datetime(days, format="mixed"), "revenue": [1.0 + i for i in range(len(days))]})
    want = rows.groupby(pd.Grouper(key="date", freq=freq))["revenue"].sum()
    got = series.period_series(spark.createDataFrame(rows), freq).orderBy("period").collect()
    assert [(pd.Timestamp(r.period), r.revenue) for r in got] == list(want.items())


def test_labels_and_indexes_agree(spark):
    days = spark.range(-4000, 30000, 7).select(F.date_from_unix_date(F.col("id").cast("int")).cast("timestamp").alias("d"))
    for freq in ("B", "W-WED", "QE-OCT", "YS-JUL", "ME"):
        p = period(freq)
        again = p.index(p.label(p.index(F.col("d"))).cast("timestamp"))
        assert days.where(again != p.index(F.col("d"))).count() == 0, freq


def test_spine_of_a_long_series_is_spread(spark):
    p = period("h")
    bounds = spark.createDataFrame([("long", 0), ("long", 2_999_999), ("short", 5), ("short", 7)], "k string, _ix bigint")
    parts = series.spine(bounds, p, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    sizes = [r["count"] for r in parts]
    assert sum(sizes) == 3_000_003 and len(sizes) == 4 and max(sizes) < 1.3 * sum(sizes) / len(sizes)


def test_previous_period_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 4)
    rows = spark.range(23).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("revenue"))
    for width in (1, 3):
        got = series.scored_series(rows, "D", width=width).orderBy("period").collect()
        assert [r.previous for r in got] == [None, *[float(i) for i in range(22)]]
