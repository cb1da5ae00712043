import pytest
from pyspark.sql import functions as F

from trustkpi.operators import evals, requests
from trustkpi.operators import toolcalls as tc
from trustkpi.sources import jsonl

GOOD = (
    '{"tool_calls":[{"method":"tools/call","params":{"name":"calculate_kpis",'
    '"arguments":{"metrics":["sales"],"date_column":"Week","detect_anomalies":true}}}]}'
)
CONTEXT = (
    'raw_header="Week" -> canonical="date" raw_header="SALES" -> canonical="sales" '
    'raw_header="store_id" -> canonical="category"'
)


@pytest.fixture(scope="module")
def examples(spark):
    return tc.generate(spark.range(500), "id")


def test_quotas_and_contract(examples):
    got = {r.category: r.n for r in tc.category_counts(examples).collect()}
    assert got == {
        "clean": 100, "noisy": 100, "adversarial": 100, "chart_only": 50, "multi_step": 50, "no_tool": 100,
    }
    assert tc.valid_examples(examples).count() == 500
    assert examples.collect() == examples.collect()


def test_distinct_keeps_the_first_and_is_idempotent(examples):
    once = tc.distinct_examples(examples)
    assert tc.distinct_examples(once).count() == once.count() < 500
    firsts = {}
    for r in sorted(examples.collect(), key=lambda r: r.id):
        firsts.setdefault((r.user_query, r.category, tuple(c.canonical for c in r.schema.columns)), r.id)
    assert {r.id for r in once.collect()} == set(firsts.values())


def test_split_sizes(examples):
    got = {(r.hard, r.split): r.n for r in tc.split(examples).groupBy(
        (F.col("category") == "adversarial").alias("hard"), "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(True, "train"): 30, (True, "adversarial_test"): 70, (False, "val"): 40, (False, "train"): 360}


def verdict_of(spark, output, truth=GOOD):
    rows = spark.createDataFrame(
        [(output, [("system", "s"), ("user", CONTEXT), ("assistant", truth)])],
        "output string, messages array<struct<role:string,content:string>>",
    )
    r = evals.score_outputs(rows).first()
    return r.compliant, r.correct, r.reasoning_failure


@pytest.mark.parametrize(
    "output, wanted",
    [
        (GOOD, (True, True, False)),
        (" ```json\n" + GOOD + "\n``` ", (True, True, False)),
        (GOOD.replace("Week", "date"), (True, True, False)),
        (GOOD.replace('["sales"]', '["ghost"]'), (True, False, True)),
        (GOOD.replace("Week", "Month"), (True, False, True)),
        (GOOD.replace('["sales"]', "[]"), (False, True, False)),
        (GOOD.replace("calculate_kpis", "run_sql"), (False, False, True)),
        (GOOD.replace("tools/call", "tools/run"), (False, True, False)),
        (GOOD[:-2], (False, False, False)),
        ("No tool needed.", (True, False, False)),
        ("Sure: " + GOOD, (False, False, False)),
        ('{"tool_calls":[]}', (True, False, True)),
        ('{"other":1}', (True, False, False)),
        ("[1]", (True, False, False)),
    ],
)
def test_verdicts(spark, output, wanted):
    assert verdict_of(spark, output) == wanted


def test_silence_is_right_when_no_call_is_due(spark):
    assert verdict_of(spark, "Just text", truth="A plain answer") == (True, True, False)
    assert verdict_of(spark, '{"tool_calls":[]}', truth="A plain answer") == (True, True, False)
    assert verdict_of(spark, GOOD, truth="A plain answer") == (True, False, True)


def test_public_rows(spark):
    call = [("function", ("f", "bad json"))]
    kind = (
        "id bigint, messages array<struct<content:string,role:string,tool_calls:array<struct<type:string,"
        "function:struct<name:string,arguments:string>>>>>, tools string"
    )
    tools = '[{"type":"function","function":{"name":"f"}}]'
    rows = spark.createDataFrame(
        [
            (1, [("hi", "user", None), (None, "assistant", call)], tools),
            (2, [("hi", "user", None)], tools),
            (3, [("hi", "user", None), (None, "assistant", call)], "oops"),
            (4, [("hi", "user", None), ("x", "assistant", None)], tools),
        ],
        kind,
    )
    got = {r.id: [m.content for m in r.messages] for r in tc.convert_public(rows).collect()}
    assert set(got) == {1, 4}
    assert got[1][2].endswith('"params":{"name":"f","arguments":{}}}]}')
    assert "- f: no description" in got[1][1] and got[4][2].startswith("That request doesn't need")
    blended = tc.blend(tc.chat_rows(tc.generate(spark.range(20), "id")), rows, 1)
    assert blended.count() == 21


def test_jsonl_round_trip(spark, examples, tmp_path):
    path = str(tmp_path / "raw")
    jsonl.write_rows(examples, path)
    assert sorted(jsonl.read_examples(spark, path).collect()) == sorted(examples.collect())
    chats = str(tmp_path / "chat")
    jsonl.write_rows(tc.chat_rows(tc.split(examples)), chats)
    assert jsonl.read_chat_rows(spark, chats + "/split=val").count() == 40


def test_requests(spark):
    body = '{"jsonrpc":"%s","id":1,"method":"%s","params":{"name":"%s","arguments":{"period":"D"}}}'
    rows = spark.createDataFrame(
        [
            (1, 7, body % ("1.0", "tools/list", "")), (2, 7, body % ("2.0", "initialize", "")),
            (3, 8, body % ("2.0", "tools/call", "calculate_kpis")), (4, 7, body % ("2.0", "tools/call", "nope")),
            (5, 7, body % ("2.0", "tools/call", "calculate_kpis")), (6, 7, body % ("2.0", "x/y", "")), (7, 7, "junk"),
        ],
        "n int, dataset_id int, payload string",
    )
    known = spark.createDataFrame([(7,)], "dataset_id int")
    got = {r.n: (r.outcome, r.code) for r in requests.classify(rows, known).collect()}
    assert got == {
        1: ("error", -32600), 2: ("initialize", None), 3: ("error", -32000), 4: ("tool_error", None),
        5: ("dispatch", None), 6: ("error", -32601), 7: ("error", -32600),
    }
    assert {r.code for r in requests.classify(rows).where("n = 5").collect()} == {-32000}


@pytest.mark.parametrize("arguments,kept", [
    ('{"b": 1, "a": {"y": [1, 2.50], "x": null}}', '{"b":1,"a":{"y":[1,2.5],"x":null}}'), ('{"k": 1, "z": 0, "k": "é\\u00e9/\\/"}', '{"k":"\\u00e9\\u00e9//","z":0}'),
    ('{"big": 123456789012345678901234567890, "e": 1E2}', '{"big":123456789012345678901234567890,"e":100.0}'), ("k: 1", "{}"), (None, "{}"), ("", "{}"),
    ('"😀"', '"\\ud83d\\ude00"'), ("[" * 100_000, "{}"),
])
def test_arguments_keep_order_and_signs(spark, arguments, kept):
    rows = spark.createDataFrame(
        [(1, [("hi", "user", None), (None, "assistant", [("function", ("naïve", arguments))])], "[]")],
        "id int, messages array<struct<content:string,role:string,tool_calls:array<struct<type:string,function:struct<name:string,arguments:string>>>>>, tools string",
    )
    got = tc.convert_public(rows).first().messages[2].content
    assert got == '{"tool_calls":[{"method":"tools/call","params":{"name":"na\\u00efve","arguments":' + kept + "}}]}"


def test_fences_and_spaces_are_taken_off_once(spark):
    expression = evals.parse_calls(F.col("t"))._jc.toString()
    assert expression.count("```(json)?") == 1
    texts = ["```json\n{}\n``` ", "``````", "\u3000x \u2028", " ```\n", "a```", "```jsonx", "a b", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.bare for r in rows.select("i", evals.strip_fences(F.col("t")).alias("bare")).orderBy("i").collect()]
    assert got == ["{}", "", "x", "", "a", "x", "a b", "", None]


def test_missing_id_and_samples_in_draw_order(spark):
    import hashlib

    from trustkpi.functions import draws

    rows = spark.createDataFrame([(7,), (None,)], "id bigint")
    words = ["x", "y", "z"]
    taken = draws.sample(F.col("id"), 3, "s", words, F.lit(2))
    assert "lambda" not in taken._jc.toString().split("sort_array")[0] and "sort_array" in taken._jc.toString()
    got = {r.id: (r.d, r.w) for r in rows.select("id", draws.draw(F.col("id"), 3, "s").alias("d"), taken.alias("w")).collect()}
    for row_id, head in ((7, "7|"), (None, "")):
        digest = lambda slot: hashlib.md5((head + "3|" + slot).encode()).hexdigest()  # noqa: B023, E731
        assert got[row_id] == (int(digest("s")[:8], 16), sorted(words, key=lambda v: digest("s:" + v))[:2])


def test_contract_is_tested_on_staged_calls(spark, tmp_path):
    from trustkpi.queries import tool_queries

    spark.createDataFrame([(i, "view") for i in range(20)], "event_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    out = tool_queries.validate(spark, str(tmp_path))
    assert "md5" not in out._jdf.queryExecution().toString()
    assert out.count() == 20 - sum(i % 10 < 8 and i % 13 in (1, 2) or i % 13 == 3 and i % 10 in (0, 1, 2, 3, 4, 5, 7) or i % 13 == 4 and i % 10 in (6, 7) for i in range(20))
