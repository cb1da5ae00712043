import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from trustkpi.functions.periods import period
from trustkpi.operators import kpi, ranking, series

ROWS = [("2024-01-01", 1.0), ("2024-01-01", 2.0), ("2024-01-04", 3.0), ("2024-02-10", 4.0)]


def canonical(spark, rows):
    return spark.createDataFrame(rows, "date string, revenue double").withColumn("date", F.to_timestamp("date"))


@pytest.mark.parametrize(
    "freq, wanted",
    [
        ("W", {"2024-01-07": 6, "2024-01-14": 0, "2024-01-21": 0, "2024-01-28": 0, "2024-02-04": 0, "2024-02-11": 4}),
        ("W-MON", {"2024-01-01": 3, "2024-01-08": 3, "2024-01-15": 0, "2024-01-22": 0, "2024-01-29": 0,
                   "2024-02-05": 0, "2024-02-12": 4}),
        ("ME", {"2024-01-31": 6, "2024-02-29": 4}), ("MS", {"2024-01-01": 6, "2024-02-01": 4}),
        ("QE", {"2024-03-31": 10}), ("YE", {"2024-12-31": 10}), ("YS", {"2024-01-01": 10}),
    ],
)
def test_labels_and_zero_fill(spark, freq, wanted):
    got = series.period_series(canonical(spark, ROWS), freq).collect()
    assert {str(r.period): r.revenue for r in got} == wanted


def test_daily_and_two_day_bins(spark):
    rows = canonical(spark, ROWS)
    daily = {str(r.period): r.revenue for r in series.period_series(rows, "D").collect()}
    assert len(daily) == 41 and daily["2024-01-01"] == 3 and daily["2024-01-02"] == 0 and daily["2024-02-10"] == 4
    pairs = {str(r.period): r.revenue for r in series.period_series(rows, "2D").collect()}
    assert pairs["2024-01-01"] == 3 and pairs["2024-01-03"] == 3 and pairs["2024-01-05"] == 0
    hours = series.period_series(rows, "6h").collect()
    assert len(hours) == 40 * 4 + 1


def brute_scores(values, width=3):
    n, mean = len(values), sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / n)
    out = []
    for i, v in enumerate(values):
        part = values[max(0, i - width + 1): i + 1]
        m = sum(part) / len(part)
        s = math.sqrt(sum((x - m) ** 2 for x in part) / len(part))
        out.append((abs(v - mean) / std, abs(v - m) / s if len(part) >= 2 and s > 0 else 0.0))
    return out


@pytest.mark.parametrize("block", [4, 4096])
def test_scores_match_brute_force_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK", block)
    random.seed(3)
    days = sorted(random.sample(range(60), 30))
    amounts = {d: round(random.uniform(1, 100), 2) for d in days}
    start = dt.date(2024, 1, 1)
    rows = canonical(spark, [(str(start + dt.timedelta(days=d)), v) for d, v in amounts.items()])
    got = series.scored_series(rows, "D").orderBy("_ix").collect()
    values = [amounts.get(d, 0.0) for d in range(days[0], days[-1] + 1)]
    assert [r.revenue for r in got] == values
    for row, (z, dev) in zip(got, brute_scores(values)):
        assert row.z_score == pytest.approx(z) and row.rolling_dev == pytest.approx(dev, abs=1e-9)


def test_keyed_equals_single_and_null_key(spark):
    rows = spark.createDataFrame(
        [(k, f"2024-01-{d:02d}", float(d * m)) for k, m in (("a", 1), (None, 3)) for d in (1, 2, 5, 9)],
        "k string, date string, revenue double",
    ).withColumn("date", F.to_timestamp("date"))
    keyed = {r.k: r for r in kpi.kpis(rows, "D", ["k"]).collect()}
    for key in ("a", None):
        alone = kpi.kpis(rows.where(F.col("k").eqNullSafe(F.lit(key))).drop("k"), "D").first()
        assert {**keyed[key].asDict(), "k": 0} == {**alone.asDict(), "k": 0}


def test_short_flat_and_empty_series(spark):
    two = canonical(spark, [("2024-01-01", 1.0), ("2024-01-02", 5.0)])
    assert kpi.anomalies(two).count() == 0
    flat = canonical(spark, [(f"2024-01-0{d}", 4.0) for d in range(1, 6)])
    assert kpi.anomalies(flat).count() == 0
    one = canonical(spark, [("2024-01-01", 4.0)])
    assert kpi.kpis(one).first().growth_rate == 0.0
    assert kpi.forecast(one).first().forecast_next_period_revenue is None
    assert kpi.kpis(one.where("false")).count() == 0
    zero_before = canonical(spark, [("2024-01-01", 4.0), ("2024-01-03", 4.0)])
    assert kpi.kpis(zero_before).first().growth_rate == 0.0
    with pytest.raises(ValueError):
        kpi.kpis(one.drop("date"))


def test_forecast_matches_known_weekly_line(spark):
    points = [21450, 31900, 29300, 48350, 30300, 35900, 26550, 30700, 30650, 37100, 40500, 20500]
    start = dt.date(2024, 1, 7)
    rows = canonical(spark, [(str(start + dt.timedelta(days=7 * i)), float(v)) for i, v in enumerate(points)])
    assert kpi.forecast(rows, "W").first().forecast_next_period_revenue == 32499.24
    assert kpi.kpis(rows, "W").first().growth_rate == -49.38


def test_median_with_ties_and_hot_key(spark):
    random.seed(5)
    data = [("hot", 7.0)] * 300 + [("hot", random.uniform(-1e6, 1e6)) for _ in range(301)]
    data += [("even", v) for v in (3.0, 1.0, 2.0, 10.0)] + [("one", -4.5)] + [("wide", v) for v in (-1e300, 1e300, 5.0)]
    rows = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r["median"] for r in ranking.exact_median(rows, ["k"], F.col("v")).collect()}
    for key in ("hot", "even", "one", "wide"):
        values = sorted(v for k, v in data if k == key)
        n = len(values)
        assert got[key] == pytest.approx((values[(n - 1) // 2] + values[n // 2]) / 2)


def test_take_lowest_is_exact_with_equal_draws(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("d", F.col("id") % 7)
    out = ranking.take_lowest(
        rows, ["g"], F.col("d"), "id", lambda n: F.floor(n * 0.3), "low"
    ).collect()
    assert len(out) == 1000
    for g in range(3):
        group = sorted((r.d, r.id) for r in out if r.g == g)
        wanted = {i for _, i in group[: int(len(group) * 0.3)]}
        assert {r.id for r in out if r.g == g and r.low} == wanted


def test_running_totals_over_sparse_positions(spark):
    random.seed(1)
    positions = sorted(random.sample(range(2**40), 300) + list(range(300)))
    rows = spark.createDataFrame([(p, p % 5) for p in positions], "p bigint, v bigint")
    got = {r.p: r.total for r in ranking.running_totals(rows, "p", {"total": F.col("v")}).collect()}
    total = 0
    for p in positions:
        total += p % 5
        assert got[p] == total


def test_nested_report_needs_days(spark):
    with pytest.raises(ValueError):
        kpi.kpi_report(canonical(spark, ROWS), "h")
    row = kpi.kpi_report(canonical(spark, ROWS), "D").first()
    assert len(row.series) == 41 and row.series[0].date == "2024-01-01" and row.anomalies["count"] == 3
    assert sum(p.revenue for p in row.series) == row.total_revenue == 10.0
    assert period("D").multiple == 1
