"""Executing tool requests."""

import json

import pytest
from pyspark.sql import functions as F
from samples import TRUST, TRUST_COLUMNS

from trustkpi.operators import requests
from trustkpi.plans import dispatch
from trustkpi.plans.prepare import prepare


def call(name, arguments=None, method="tools/call", version="2.0"):
    return json.dumps({"jsonrpc": version, "id": 1, "method": method, "params": {"name": name, "arguments": arguments or {}}})


def test_requests_are_run_and_answered(spark):
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(TRUST)], ["_pos", *TRUST_COLUMNS])
    one = prepare(raw).canonical
    canonical = one.withColumn("dataset_id", F.lit("trust")).unionByName(
        one.limit(0).withColumn("dataset_id", F.lit("bare"))
    )
    asked = [
        ("trust", call("calculate_kpis", {"period": "D"})), ("trust", call("calculate_kpis", {"other": 1})),
        ("trust", call("calculate_kpis", {"period": "fortnight"})), ("trust", call("calculate_kpis", {"period": "h"})),
        ("trust", call("generate_chart", {"chart_type": "pie", "x_field": "region"})), ("trust", call("generate_chart", {"chart_type": "radar", "x_field": "region"})),
        ("trust", call("generate_chart", {"chart_type": "bar"})), ("trust", call("generate_chart_set", {"max_charts": 2})),
        ("trust", call("generate_chart_set", {"max_charts": "many"})), ("bare", call("calculate_kpis")), ("gone", call("calculate_kpis")),
        ("trust", call("drop_table")), ("trust", call("x", method="tools/list")), ("trust", call("x", version="1.0")),
        ("trust", call("generate_chart", {"y_field": "planet"})),
    ]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "n int, dataset_id string, payload string")
    known = spark.createDataFrame([("trust",), ("bare",)], "dataset_id string")
    got = dispatch.dispatch(requests.classify(rows, known), canonical).orderBy("n").collect()
    answers = [json.loads(r.result) if r.result else None for r in got]
    assert [r.is_error for r in got] == [False, False, True, True, False, True, True, False, True, True, True, True, False, True, True]
    assert answers[0] == answers[1] and answers[0]["total_revenue"] == 920.0 and answers[0]["anomalies"]["dates"] == ["2024-01-04"]
    assert answers[4]["type"] == "pie" and sum(p["y"] for p in answers[4]["data_points"]) == 920.0
    assert [c["id"] for c in answers[7]["charts"]] == ["revenue-trend", "category-bar"]
    assert answers[7]["recommendations"] == [
        {"chart_type": "line", "x_field": "date", "y_field": "revenue"}, {"chart_type": "bar", "x_field": "category", "y_field": "revenue"}]
    assert "fortnight" in got[2].message and "radar" in got[5].message and "many" in got[8].message and got[9].message == dispatch.NO_ROWS
    assert got[10].code == -32000 and got[11].message == "Unknown tool: drop_table" and got[12].message is None and got[13].code == -32600


def test_nothing_to_run_and_too_much(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", call("x", method="tools/list")), (2, "a", "not json")], "n int, dataset_id string, payload string")
    canonical = spark.createDataFrame([], "dataset_id string, date timestamp, revenue double")
    got = dispatch.dispatch(requests.classify(rows, rows), canonical).orderBy("n").collect()
    assert [(r.is_error, r.result) for r in got] == [(False, None), (True, None)]
    monkeypatch.setattr(dispatch, "MOST_GROUPS", 0)
    calls = spark.createDataFrame([("a", call("calculate_kpis"))], "dataset_id string, payload string")
    with pytest.raises(ValueError, match="different calls"):
        dispatch.dispatch(requests.classify(calls, calls), canonical)


def test_results_are_read_once_each(spark):
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(TRUST)], ["_pos", *TRUST_COLUMNS])
    canonical = prepare(raw).canonical.withColumn("dataset_id", F.lit("trust"))
    rows = spark.createDataFrame(
        [(i, "trust", call("calculate_kpis", {"period": p, "n": i})) for i, p in enumerate(["D", "D", "fortnight"])],
        "n int, dataset_id string, payload string",
    )
    known = spark.createDataFrame([("trust",)], "dataset_id string")
    told = lambda result: {"total": F.get_json_object(result, "$.total_revenue").cast("double")}
    got = dispatch.dispatch(requests.classify(rows, known), canonical, read=told).select("n", "is_error", "total")
    assert "get_json_object" not in got._jdf.queryExecution().toString()
    assert [(r.is_error, r.total) for r in got.orderBy("n").collect()] == [(False, 920.0), (False, 920.0), (True, None)]
