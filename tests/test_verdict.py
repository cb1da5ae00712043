"""Cases at the edges of the rules: long integers, infinities, date bounds, blank columns, early stops."""

import math

import pytest
from pyspark.sql import functions as F

from trustkpi.functions import dates, numbers
from trustkpi.operators import clean, facts, quality, ranking, requests
from trustkpi.plans.prepare import prepare
from trustkpi.plans.report import analyze, report_rows


def texts(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def one(spark, value, expression):
    return texts(spark, ["t"], [(value,)]).select(expression).first()[0]


def test_long_integers_stay_apart_and_spellings_meet(spark):
    ids = ["1234567890123456789", "1234567890123456790", "1234567890123456791", "9" * 25, "007", "7", "+7", "-0", "0", "-007"]
    out = clean.clean(texts(spark, ["ref"], [(i,) for i in ids])).collect()
    assert {r.ref: r["_copies"] for r in out} == {
        "1234567890123456789": 1, "1234567890123456790": 1, "1234567890123456791": 1, "9" * 25: 1, "7": 3, "0": 2, "-7": 1,
    }


@pytest.mark.parametrize("given, wanted", [
    ("1e308", 1e308), ("9" * 300 + "e50", None), ("1e309", None), ("-1e309", None), ("9" * 300, 1e300), ("1e+5", 1e5),
])
def test_numbers_up_to_the_largest(spark, given, wanted):
    got = one(spark, given, numbers.parse_number("t"))
    assert got == (pytest.approx(wanted) if wanted is not None else None)


@pytest.mark.parametrize("given, wanted", [
    ("2262-04-11", "2262-04-11"), ("2262-04-12", None), ("1677-09-22", "1677-09-22"), ("1677-09-21", None),
    ("2024.01.05", "2024-01-05"), ("5 Jan 2024 10:00", "2024-01-05"), ("Jan 5, 2024 10:00", "2024-01-05"),
    ("2024 Jan 5", "2024-01-05"), ("Sept 5, 2024", "2024-09-05"), ("01-Feb-24", "2024-02-01"), ("1/2024", "2024-01-01"),
    ("20240105T101500", "2024-01-05"), ("5 OCT 2024", "2024-10-05"),
])
def test_dates_at_the_bounds_and_in_more_shapes(spark, given, wanted):
    assert one(spark, given, F.date_format(dates.parse_date("t"), "yyyy-MM-dd")) == wanted


def test_ranks_with_infinities_and_many_magnitudes(spark):
    def median(values):
        rows = spark.createDataFrame([(float(v),) for v in values], "v double")
        return ranking.exact_median(rows, [], F.col("v")).first()["median"]

    assert median([1, 2, math.inf]) == 2.0
    assert median([-math.inf, 1, math.inf]) == 1.0
    assert median([10.0 ** (k / 4 - 250) for k in range(2001)]) == 1.0


def test_blank_only_column_counts_as_missing(spark):
    raw = texts(spark, ["a", "b", "c"], [(f"x{i}", " ", None) for i in range(24)])
    cleaned = clean.clean(raw)
    report = quality.quality_report(cleaned, (), clean.present_columns(clean.raw_state(raw))).first()
    assert report["missing_values"] == {"a": 0, "b": 24}
    assert report["quality_score"] == 0.75


def test_dataset_stopped_by_the_first_gate_has_no_roles(spark):
    good = [("good", f"2024-01-{d:02d}", str(100 + d), "A" if d % 2 else "B", "N") for d in range(1, 21)]
    copies = [("copies", "2024-01-01", "5", "A", "N")] * 6 + good[:3]
    raw = texts(spark, ["k", "date", "revenue", "category", "region"], good + [("copies", *r[1:]) for r in copies])
    done = prepare(raw, ["k"])
    assert {r.k for r in done.schema.collect()} == {"good"}
    assert {r.k for r in done.canonical.select("k").distinct().collect()} <= {"good"}
    status = {r.k: r for r in done.status.collect()}
    assert status["copies"].status == "failed" and status["copies"].confidence == status["copies"].quality_score
    expected = spark.createDataFrame([("good",), ("gone",)], "k string")
    rows = {r.k: r for r in report_rows(analyze(raw, ["k"], expected=expected), ["k"]).collect()}
    assert rows["gone"].status == "failed" and rows["copies"].date_col is None


def test_warning_order_and_version_and_rejects(spark):
    supplied = spark.sql("SELECT 1 AS k, 'T' AS title, 'S' AS summary, cast(NULL AS array<struct<title:string,body:string,tone:string>>) "
                         "AS insights, cast(NULL AS array<struct<id:string,eyebrow:string,headline:string,copy:string,chart_id:string>>) "
                         "AS story, cast(NULL AS array<string>) AS suggested_questions, array('X') AS warnings")
    base = supplied.withColumn("warnings", F.array(F.lit("Dup rows"), F.lit("Dup rate")))
    own = spark.sql("SELECT 1 AS k, array('Dup rows') AS warnings")
    assert facts.choose_texts(supplied, base, ["k"], own).first()["warnings"] == ["Dup rows", "X", "Dup rate"]
    payloads = ['{"jsonrpc":"2.0","id":1,"method":"tools/list"}', '{"jsonrpc":2.0,"id":1,"method":"tools/list"}', "x"]
    got = requests.classify(texts(spark, ["payload"], [(p,) for p in payloads])).collect()
    assert [r.outcome for r in got] == ["tools/list", "error", "error"]
    asked = spark.createDataFrame([(1, "r", "why"), (2, "r", " ")], "question_id int, report_id string, message string")
    assert [(r.question_id, r.reject_reason) for r in facts.rejected_questions(asked).collect()] == [(2, "empty")]
