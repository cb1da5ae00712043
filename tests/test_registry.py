import os

import oracle
import pytest

import __spark_entry__ as registry
from trustkpi.queries import ALL

FOLDER = "/root/testdata/sf0.001"
CORE = [
    "monthly_kpi_series", "kpis_by_segment", "series_seven_day", "median_by_segment", "chart_set", "parse_numeric",
    "cleaned_rows", "gate_status_with_holes", "fact_summary", "toolcall_split", "eval_scores", "request_status",
]
NAMES = sorted(ALL) if os.environ.get("TRUSTKPI_ALL") else CORE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, tables, name):
    ok, note = oracle.compare(spark, tables, FOLDER, name)
    assert ok, note


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(registry.oracle_sql()) >= set(ALL)
    assert registry.entry(spark).columns[:3] == ["segment", "period", "revenue"]
