import pytest
from pyspark.sql import functions as F
from samples import REGIONAL_COLUMNS, TRUST, TRUST_COLUMNS, regional, watchlist

from trustkpi.operators import charts, clean, facts, kpi
from trustkpi.plans.prepare import prepare
from trustkpi.plans.report import analyze, report_rows
from trustkpi.plans.tools import run_tool, tool_table
from trustkpi.sources import csvs, store


def frame(spark, rows, columns):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["_pos", *columns])


def all_sets(spark):
    parts = []
    for name, rows in (("regional", regional()), ("watchlist", watchlist())):
        parts.append(frame(spark, rows, REGIONAL_COLUMNS).withColumn("ds", F.lit(name)))
    return parts[0].unionByName(parts[1])


@pytest.fixture(scope="module")
def analysis(spark):
    return analyze(all_sets(spark), ["ds"])


def test_normalises_before_counting_duplicates(spark):
    raw = frame(
        spark,
        [("2024-01-01", "100", " electronics ", " north"), ("2024-01-01", "100", "Electronics", "North "),
         ("2024-01-02", "bad", "furniture", "south")],
        ["Order Date", "Revenue", "Category", "Region"],
    )
    done = prepare(clean.normalize_headers(raw, ["_pos"]))
    status = done.status.first()
    assert status.duplicate_rows == 1 and status.duplicate_percent == 0.3333
    assert status.invalid_numeric["revenue"] == 1
    rows = done.cleaned.orderBy("_pos").collect()
    assert [r.category for r in rows] == ["Electronics", "Furniture"]
    assert [r.region for r in rows] == ["North", "South"]
    assert (status.status, status.quality_score) == ("failed", 0.4)
    assert clean.drop_duplicates(done.cleaned.drop("_copies"), []).count() == 2


def test_duplicate_gate(spark):
    raw = spark.createDataFrame(
        [("2024-01-01", "100", "A", "North")] * 2
        + [("2024-01-02", "120", "A", "North"), ("2024-01-03", "130", "B", "South")],
        ["date", "revenue", "category", "region"],
    )
    status = prepare(raw).status.first()
    assert (status.status, status.reason) == ("failed", "Data quality too low")
    assert (status.duplicate_percent, status.quality_score, status.confidence) == (0.25, 0.65, 0.65)
    assert status.warnings[-1] == "Revenue column inferred with low confidence"


def test_trust_sample(spark):
    done = prepare(frame(spark, TRUST, TRUST_COLUMNS))
    schema, status = done.schema.first(), done.status.first()
    assert (schema.date_col, schema.revenue_col) == ("order date", "revenue")
    assert (status.status, schema.confidence) == ("success", pytest.approx(0.914, abs=1e-3))
    row = kpi.kpi_report(done.canonical).first()
    assert (row.total_revenue, row.average_revenue, row.row_count, row.growth_rate) == (920.0, 184.0, 5, -78.0)
    assert row.anomalies.dates == ["2024-01-04"] and row.anomalies.z_scores["2024-01-04"] == 1.996


def test_keyed_goldens(analysis):
    status = {r.ds: r for r in analysis.prepared.status.collect()}
    schema = {r.ds: r for r in analysis.prepared.schema.collect()}
    kpis = {r.ds: r for r in analysis.kpis.collect()}
    assert status["watchlist"].quality_score == 0.894 and status["watchlist"].negative_revenue == 1
    assert status["regional"].quality_score == 1.0 and status["regional"].warnings == []
    assert schema["regional"].confidence == pytest.approx(0.937, abs=1e-3)
    assert schema["watchlist"].confidence == pytest.approx(0.9392, abs=1e-3)
    assert (kpis["watchlist"].total_revenue, kpis["watchlist"].average_revenue) == (62500.0, 2717.39)
    assert kpis["watchlist"].anomalies.z_scores == {"2024-05-12": 2.938}
    assert kpis["regional"].growth_rate == 18.06
    assert kpis["regional"].anomalies.z_scores == {
        "2024-03-02": 1.7928, "2024-03-06": 1.6046, "2024-03-17": 1.5941, "2024-03-21": 1.845,
    }


def test_keyed_equals_single(spark, analysis):
    alone = prepare(frame(spark, watchlist(), REGIONAL_COLUMNS))
    keyed = analysis.prepared.status.where("ds = 'watchlist'").drop("ds").first()
    assert alone.status.first().asDict(True) == keyed.asDict(True)
    single = alone.schema.first().asDict(True)
    assert single == analysis.prepared.schema.where("ds = 'watchlist'").drop("ds").first().asDict(True)


def test_breakdowns_and_texts(analysis):
    bars = analysis.charts.where("ds = 'watchlist' AND type = 'bar'").orderBy("chart_pos", "pos").collect()
    assert [(r.x, r.y) for r in bars] == [
        ("Software", 24540.0), ("Hardware", 20830.0), ("Services", 17130.0),
        ("South", 17520.0), ("North", 16750.0), ("East", 14600.0), ("West", 13630.0),
    ]
    report = analysis.report.where("ds = 'watchlist'").first()
    assert report.summary.startswith("Total revenue is $62,500.00 across 23 cleaned rows")
    assert report.summary.endswith("Dataset quality score is 0.894.")
    assert report.warnings[-1] == "Duplicate rate after validation: 4.17%."
    assert [i.tone for i in report.insights] == ["neutral", "positive", "neutral", "caution"]
    assert [s.chart_id for s in report.story] == ["revenue-trend", "revenue-trend", "category-bar"]
    lines = facts.sections(analysis.report, ["ds"]).where("ds = 'watchlist' AND section = 'risks'").count()
    assert lines == 3


def test_null_revenue_fails_the_dataset_and_missing_keys_get_a_row(spark):
    rows = [r if i != 3 else (r[0], " ", *r[2:]) for i, r in enumerate(regional())]
    raw = frame(spark, rows, REGIONAL_COLUMNS).withColumn("ds", F.lit("holes"))
    expected = spark.createDataFrame([("holes",), ("gone",)], ["ds"])
    done = prepare(raw, ["ds"], expected)
    got = {r.ds: r for r in done.status.collect()}
    assert got["holes"].missing_critical_fields == ["revenue"] and got["holes"].status == "failed"
    assert got["gone"].status == "failed"
    assert done.canonical.count() == 0
    rows = report_rows(analyze(raw, ["ds"]), ["ds"]).first()
    assert rows.title == "Data Quality Gate Failed" and rows.summary.startswith("Data quality too low")


def test_equal_numbers_are_duplicates_and_empty_rows_go(spark):
    raw = spark.createDataFrame(
        [("007", "x"), ("7", "x"), ("+7", "x"), (None, None), ("8", "y")], "n string, t string"
    )
    out = clean.clean(raw)
    assert sorted((r.n, r.t, r._copies) for r in out.collect()) == [("7", "X", 3), ("8", "Y", 1)]


def test_chart_rules(spark, analysis):
    rows = spark.createDataFrame(
        [(f"c{i:02d}", 5.0) for i in range(12)] + [(None, 9.0)], "category string, revenue double"
    ).withColumn("date", F.to_timestamp(F.lit("2024-01-01")))
    top = charts.ranked_chart(rows, "category").orderBy("pos").collect()
    assert [r.x for r in top] == ["Unknown"] + [f"c{i:02d}" for i in range(9)]
    assert charts.with_share(charts.ranked_chart(rows, "category", "pie")).agg(F.sum("share")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        charts.chart(rows, "bar", "nope")
    with pytest.raises(ValueError):
        charts.chart(rows, "radar", "category")
    assert charts.chart_specs(rows, 1).count() == 1


def test_tools(spark, analysis):
    canonical = analysis.prepared.canonical
    assert run_tool("calculate_kpis", canonical, {"period": "W", "other": 1}, ["ds"]).count() == 2
    assert run_tool("generate_chart", canonical, None, ["ds"]).where("type = 'line'").count() == 47
    assert run_tool("generate_chart_set", canonical, {"max_charts": 1}, ["ds"]).select("chart_id").distinct().count() == 1
    assert {r.name for r in tool_table(spark).collect()} >= {"calculate_kpis", "generate_chart"}
    with pytest.raises(ValueError):
        run_tool("drop_table", canonical)


def test_contexts(analysis):
    first = csvs.preview(analysis.prepared.canonical, ["ds"])
    context = facts.dataset_context(analysis.prepared.schema, analysis.prepared.status, first, ["ds"])
    row = context.where("ds = 'regional'").first()
    assert len(row.preview) == 8 and row.schema.revenue_col == "revenue" and row.warnings == []
    wide = report_rows(analysis, ["ds"])
    assert facts.report_context(wide, ["ds"]).count() == 2


def test_store_round_trip(spark, analysis, tmp_path):
    rows = store.with_report_ids(report_rows(analysis, ["ds"]), ["ds"])
    envelope = store.report_envelope(rows, "app", "prompt")
    assert envelope.select("report_id").collect() == envelope.select("report_id").collect()
    path = str(tmp_path / "store")
    canonical = analysis.prepared.canonical.withColumns({"nothing": F.lit(None), "empty": F.lit(None).cast("string")})
    ids = {r.ds: r.report_id for r in store.save(envelope, path, canonical, ["ds"]).collect()}
    one = store.load_report(spark, path, f" {ids['watchlist'].upper()} ").first()
    assert one.total_revenue == 62500.0 and one.anomalies.z_scores["2024-05-12"] == 2.938
    assert one.share_url == f"/?report={ids['watchlist']}" and one.data_storage.raw_csv_stored is False
    back = store.load_records(spark, path, ids["watchlist"])
    assert back.agg(F.sum("revenue")).first()[0] == 62500.0 and dict(back.dtypes)["date"] == "timestamp"
    assert {"nothing", "empty"} <= set(back.columns) and back.where("empty IS NOT NULL OR nothing IS NOT NULL").count() == 0
    store.save(envelope.withColumn("title", F.lit("second")).where("ds = 'watchlist'"), path, canonical.limit(3), ["ds"])
    assert store.load_report(spark, path, ids["watchlist"]).first().title == "second"
    assert {r.report_id for r in store.load_reports(spark, path).collect()} == set(ids.values())
    for bad in ("../x", "ffffffffffff"):
        with pytest.raises(FileNotFoundError):
            store.load_report(spark, path, bad)


def test_store_of_many_reports(spark, tmp_path):
    path = str(tmp_path / "store")
    reports = spark.range(100_000).select("id", (F.col("id") * 2.0).alias("total_revenue"), F.lit(None).cast("double").alias("growth_rate"))
    records = spark.range(200_000).select((F.col("id") % 100_000).alias("id"), F.lit("2024-01-02").alias("date"), F.col("id").alias("revenue"), F.lit(None).cast("string").alias("region"))
    ids = store.save(reports, path, records, ["id"])
    assert ids.count() == 100_000 and ids.select("report_id").distinct().count() == 100_000
    some = ids.where("id IN (7, 99999)").orderBy("id").collect()
    for r in some:
        assert store.load_report(spark, path, r.report_id).collect() == [(r.id, 2.0 * r.id, None, r.report_id)]
        back = store.load_records(spark, path, r.report_id).orderBy("revenue").collect()
        assert [(b.revenue, b.region) for b in back] == [(float(r.id), None), (100_000.0 + r.id, None)]
    assert sum(1 for _ in (tmp_path / "store").rglob("*.parquet")) < 3 * 256 * 3
    whole = store.load_reports(spark, path)
    assert (whole.count(), whole.agg(F.sum("total_revenue")).first()[0]) == (100_000, 99_999 * 100_000.0)


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        'Order_Date,Revenue,revenue,Cat,Cat,"x, y"\n2024-01-01,"1,200",5,a,b,"q ""z"""\n\n2024-01-02,NA,7\n'
    )
    rows = csvs.read_csv(spark, str(path), key="file")
    assert rows.columns == ["_pos", "file", "order date", "revenue", "revenue_1", "cat", "cat.1", "x, y"]
    first, second = rows.orderBy("_pos").collect()
    assert first["revenue"] == "1,200" and first["x, y"] == 'q "z"' and first["file"].endswith("/a.csv")
    assert second["revenue"] is None and second["cat"] is None
    wide = tmp_path / "b.csv"
    wide.write_text('a,b\n1,2\n1,2,3\n1\n"x,y",2\n')
    assert csvs.read_csv(spark, str(wide), surplus="drop").count() == 3
    assert [r.line for r in csvs.surplus_rows(spark, str(wide)).collect()] == ["1,2,3"]
    with pytest.raises(Exception, match="more fields"):
        csvs.read_csv(spark, str(wide)).collect()
    empty = tmp_path / "c.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        csvs.read_csv(spark, str(empty))
    header_only = tmp_path / "d.csv"
    header_only.write_text("a,b\n")
    with pytest.raises(ValueError):
        csvs.require_rows(csvs.read_csv(spark, str(header_only)))


def test_csv_files_keep_their_own_headers(spark, tmp_path):
    texts = {
        "x/sales.csv": "Order Date,Revenue,Region,Kind\n" + "".join(
            f"2024-01-{d:02d},{100 + 7 * d},{'North' if d % 2 else 'South'},{'A' if d % 3 else 'B'}\n" for d in range(1, 25)),
        "y/sales.csv": "\n \nKind,Region,net-revenue,date\n" + "".join(
            f"{'C' if d % 3 else 'D'},{'East' if d % 2 else 'West'},${50 + d},2024-02-{d:02d}\n" for d in range(1, 25)),
        "z/a b+c[1].csv": "Kind,Region,net-revenue,date\nC,East,1,2024-02-01,9\n",
        "empty.csv": "", "blank.csv": "\n\n", "header.csv": "Order Date,Revenue\n",
    }
    for name, text in texts.items():
        place = tmp_path / name
        place.parent.mkdir(exist_ok=True)
        place.write_text(text)
    paths = [str(tmp_path), *(str(tmp_path / d) for d in "xyz")]
    files = csvs.list_files(spark, paths)
    assert len(files.scans) == 3 and files.found.count() == 6
    rows = files.rows("dataset", surplus="drop")
    name = {p.rsplit(str(tmp_path) + "/", 1)[1]: p for p in (r.path for r in files.found.collect())}
    assert set(name) == set(texts)
    got = {r.dataset: r for r in rows.groupBy("dataset").agg(F.count("*").alias("n"), F.max("revenue").alias("a"), F.max("net revenue").alias("b")).collect()}
    assert {k: (r.n, r.a, r.b) for k, r in got.items()} == {name["x/sales.csv"]: (24, "268", None), name["y/sales.csv"]: (24, None, "$74")}
    order = {(r.dataset, r.column): r.pos for r in files.columns("dataset").collect()}
    assert order[name["x/sales.csv"], "kind"] == 3 and order[name["y/sales.csv"], "kind"] == 0
    bare = {r.path: r.lines for r in files.without_rows(rows, "dataset").collect()}
    assert bare == {name["empty.csv"]: 0, name["blank.csv"]: 0, name["header.csv"]: 0, name["z/a b+c[1].csv"]: 1}
    with pytest.raises(Exception, match="more fields"):
        files.rows("dataset").collect()
    with pytest.raises(ValueError, match="different headers"):
        files.rows()
    with pytest.raises(ValueError, match="called kind"):
        files.rows("kind")
    done = prepare(rows, ["dataset"], files.datasets("dataset"), files.columns("dataset"))
    status = {r.dataset: (r.status, r.reason) for r in done.status.collect()}
    assert {k for k, (s, _) in status.items() if s == "success"} == {name["x/sales.csv"], name["y/sales.csv"]}
    assert len(status) == 6 and status[name["empty.csv"]] == status[name["header.csv"]]
    roles = {r.dataset: r for r in done.schema.collect()}
    assert (roles[name["x/sales.csv"]].revenue_col, roles[name["y/sales.csv"]].revenue_col) == ("revenue", "net revenue")
    # Region and kind score alike: the first of each file wins.
    assert [roles[name[f"{d}/sales.csv"]].category_col for d in "xy"] == ["region", "kind"]


def test_no_rows_and_no_roles_fail_quietly(spark):
    raw = frame(spark, TRUST, TRUST_COLUMNS)
    empty = prepare(raw.where("false")).status.first()
    assert empty.status == "failed" and empty.reason.startswith("CSV contains no usable rows")
    words = spark.createDataFrame([("a", f"word {chr(97 + i)}", f"text {chr(97 + i)}") for i in range(26)], ["ds", "one", "two"])
    done = prepare(words, ["ds"])
    status = done.status.first()
    assert (status.status, status.reason, status.confidence) == ("failed", "Schema confidence too low", 0.0)
    assert done.canonical.count() == 0
    assert analyze(words, ["ds"]).kpis.count() == 0


def test_cleaning_twice_changes_nothing(spark):
    once = clean.clean(frame(spark, watchlist(), REGIONAL_COLUMNS))
    again = clean.clean(once.drop("_copies"))
    columns = ["_pos", *REGIONAL_COLUMNS]
    assert sorted(once.select(columns).collect()) == sorted(again.select(columns).collect())
    assert clean.duplicate_summary(again).first().duplicate_rows == 0
