"""Cleaning, quality, profile, schema and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustkpi import fixed
from trustkpi.functions import dates, numbers, text
from trustkpi.operators import clean, profile, quality, requests, schema
from trustkpi.operators.canonical import canonicalize
from trustkpi.operators.keyed import attach
from trustkpi.plans.prepare import prepare
from trustkpi.queries import inputs as src
from trustkpi.sources import csvs, store

KEY = src.SALES_KEY
DATA = src.SALES_COLUMNS


# --- column functions ----------------------------------------------------------

_MESSY = (
    "CASE l_orderkey % 9 WHEN 0 THEN '$' || a WHEN 1 THEN '(' || a || ')' WHEN 2 THEN ' ' || a || ' ' "
    "WHEN 3 THEN a || '%' WHEN 4 THEN 'bad' WHEN 5 THEN '' WHEN 6 THEN 'Store ' || a WHEN 7 THEN a || 'e1' "
    "ELSE '-' || a END"
)


def parse_numeric(spark, folder):
    rows = src.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "cast(cast(l_extendedprice AS decimal(18,2)) AS string) AS a"
    ).selectExpr("l_orderkey", "l_linenumber", "a", _MESSY + " AS t")
    return rows.select("l_orderkey", "l_linenumber", "a", F.round(numbers.parse_number("t"), 4).alias("value"))


PARSE_NUMERIC_SQL = f"""SELECT l_orderkey, l_linenumber, a, round({src.number_sql('t')}, 4) AS value FROM (
SELECT l_orderkey, l_linenumber, a, {_MESSY} AS t FROM (
SELECT l_orderkey, l_linenumber, cast(cast(l_extendedprice AS decimal(18,2)) AS varchar) AS a FROM lineitem))"""

_DATE_TEXT = (
    "CASE o_orderkey % 8 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} "
    "WHEN 5 THEN {5} WHEN 6 THEN 'soon' ELSE {6} END"
)


def parse_dates(spark, folder):
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyyMMdd", "yyyy/M/d", "yyyy-MM-dd HH:mm:ss"]
    shown = _DATE_TEXT.format(*[f"date_format(o_orderdate, '{f}')" for f in forms])
    rows = src.table(spark, folder, "orders").selectExpr("o_orderkey", shown + " AS t")
    return rows.select("o_orderkey", F.to_date(dates.parse_date("t")).alias("parsed"))


# The parsed text must give back the date it was written from; 'soon' gives none.
PARSE_DATES_SQL = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 6 THEN cast(o_orderdate AS date) END AS parsed FROM orders"
)

_LABEL = (
    "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || replace(p_name, ' ', '-') "
    "WHEN 2 THEN p_type || '  o''' || p_name ELSE 'a1' || p_name || ' 2' || p_type END"
)


def title_labels(spark, folder):
    rows = src.table(spark, folder, "part").selectExpr("p_partkey", _LABEL + " AS t")
    return rows.select("p_partkey", text.normalize_label("t").alias("label"))


def normalize_documents(spark, folder):
    rows = src.table(spark, folder, "documents").select("doc_id", text.normalize_text("text").alias("t"))
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("chars"))


_BLANK = (
    "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN '\t ' "
    "WHEN 4 THEN ' ' || c_name ELSE c_name END"
)


def blank_mask(spark, folder):
    rows = src.table(spark, folder, "customer").selectExpr("c_custkey", _BLANK + " AS t")
    return rows.select("c_custkey", text.is_blank("t").alias("blank"))


_TOKEN = (
    "CASE event_id % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'N/A' WHEN 2 THEN ' ' WHEN 3 THEN 'null' "
    "WHEN 4 THEN 'NaN' WHEN 5 THEN 'none' ELSE event_type END"
)


def null_tokens(spark, folder):
    rows = src.table(spark, folder, "events").selectExpr("event_id", _TOKEN + " AS t")
    return rows.select("event_id", text.null_tokens_to_null("t").alias("value"))


def headers(spark, folder):
    rows = src.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias(" S_SuppKey "), F.col("s_name").alias("Supplier--NAME"),
        F.col("s_nationkey").alias("Nation Key"), F.col("s_acctbal").alias("NATION_KEY"),
    )
    return clean.normalize_headers(rows)


def drop_empty(spark, folder):
    rows = src.table(spark, folder, "customer").selectExpr(
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance",
        "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS segment",
        "cast(NULL AS string) AS nothing",
    )
    kept = clean.drop_empty_columns(rows)
    return clean.drop_empty_rows(kept, kept.columns)


def usable_texts(spark, folder):
    rows = src.table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "CASE WHEN conv_id % 9 = 0 THEN '  ' ELSE text END AS text"
    )
    good, bad = requests.usable_texts(rows, "text", fixed.MESSAGE_MAX_CHARS)
    both = good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad)
    return both.select("conv_id", "turn", "reject_reason")


# --- messy sales: SQL building blocks --------------------------------------------


def q(name: str) -> str:
    return f'"{name}"'


def _clean_ctes(holes: bool) -> str:
    """CTEs raw, vals, rules, std, dedup over the messy table."""
    raw = src.raw_sales_sql(holes)
    normed = ", ".join(f"{src.norm_sql(q(c))} AS {q(c)}" for c in DATA)
    long = " UNION ALL ".join(f"SELECT dataset, '{c}' AS col, {q(c)} AS v FROM norm" for c in DATA)
    std = ", ".join(
        f"CASE r['{c}'] WHEN 'text' THEN {q(c)} WHEN 'label' THEN {src.title_sql(q(c))} "
        f"WHEN 'integer' THEN cast(try_cast({q(c)} AS bigint) AS varchar) "
        f"WHEN 'number' THEN cast(try_cast({q(c)} AS double) AS varchar) END AS {q(c)}"
        for c in DATA
    )
    group = ", ".join(q(c) for c in DATA)
    return f"""
raw AS ({raw}),
norm AS (SELECT _pos, dataset, {normed} FROM raw),
vals AS (SELECT dataset, col, v, count(*) AS n FROM ({long}) GROUP BY dataset, col, v),
kinds AS (SELECT dataset, col, sum(n) AS nn, count(v) AS dv,
  bool_and(regexp_full_match(v, '[+-]?[0-9]{{1,18}}')) AS isint,
  bool_and(regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) AS isnum
  FROM vals WHERE v IS NOT NULL GROUP BY dataset, col),
rules AS (SELECT dataset, col, CASE WHEN isint THEN 'integer' WHEN isnum THEN 'number'
  WHEN dv BETWEEN 2 AND greatest(12, floor(nn * 0.2)) THEN 'label' ELSE 'text' END AS rule FROM kinds),
rulemap AS (SELECT dataset, map(list(col), list(rule)) AS r FROM rules GROUP BY dataset),
std AS (SELECT _pos, dataset, {std} FROM norm JOIN rulemap USING (dataset)),
dedup AS (SELECT dataset, {group}, min(_pos) AS _pos, count(*) AS copies FROM std GROUP BY dataset, {group})
"""


def _quality_ctes(holes: bool) -> str:
    """CTEs colq and report after the cleaning CTEs."""
    pieces = []
    for c in DATA:
        number = src.number_sql(q(c))
        negative = f"count(*) FILTER ({number} < 0)" if quality.has_hint(c, fixed.REVENUE_LIKE_HINTS) else "0"
        hinted = "true" if quality.has_hint(c, fixed.NUMERIC_HINTS) else "false"
        pieces.append(
            f"SELECT dataset, '{c}' AS col, count(*) AS rows_, count(*) - count({q(c)}) AS missing, "
            f"count({number}) AS ok, count({q(c)}) - count({number}) AS bad, {negative} AS negative, "
            f"({hinted} OR count({number}) / count(*) >= 0.6) AS candidate FROM dedup GROUP BY dataset"
        )
    return _clean_ctes(holes) + f""",
colq AS (SELECT dataset, col, rows_, missing, ok, CASE WHEN candidate THEN bad END AS invalid, negative, candidate
  FROM ({' UNION ALL '.join(pieces)}) WHERE missing < rows_),
dups AS (SELECT dataset, cast(sum(copies) AS bigint) AS before, count(*) AS after,
  cast(sum(copies) - count(*) AS bigint) AS dup, round((sum(copies) - count(*)) / greatest(sum(copies), 1), 4) AS pct
  FROM dedup GROUP BY dataset),
sums AS (SELECT dataset, sum(missing) AS missing, coalesce(sum(invalid), 0) AS invalid, sum(negative) AS negative
  FROM colq GROUP BY dataset),
report AS (SELECT dataset, before, after, dup, pct, cast(missing AS bigint) AS missing,
  cast(invalid AS bigint) AS invalid, cast(negative AS bigint) AS negative,
  round(greatest(0, least(1, 1 - (least(0.35, pct * 1.5) + least(0.25, missing / after * 0.8)
    + least(0.25, invalid / after) + least(0.15, negative / after)))), 4) AS score
  FROM dups JOIN sums USING (dataset))
"""


def _hints(col: str, hints: list[str]) -> str:
    listed = ", ".join(f"'{h}'" for h in hints)
    return f"least(0.25, 0.12 * len(list_intersect(string_split({col}, ' '), [{listed}])))"


def _schema_ctes(holes: bool) -> str:
    """CTEs prof, cand, final and detected after the quality CTEs."""
    position = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(DATA))
    long = " UNION ALL ".join(f"SELECT dataset, '{c}' AS col, {q(c)} AS v FROM dedup" for c in DATA)
    strict = "regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
    number = {"revenue": "rr", "price": "rr", "quantity": "rr"}
    parts = []
    for role in schema.ROLES:
        bonus = _hints("col", fixed.ROLE_HINTS[role])
        if role == "date":
            score = f"CASE WHEN dr >= 0.6 THEN round(least(1, dr * 0.85 + {bonus}), 4) ELSE 0 END"
        elif role in number:
            score = f"CASE WHEN rr >= 0.7 THEN round(least(1, rr * 0.8 + {bonus}), 4) ELSE 0 END"
        else:
            score = (
                f"CASE WHEN dv >= 2 AND dv / nn <= 0.6 THEN round(least(1, (1 - dv / nn) * 0.75 + {bonus}), 4) "
                "ELSE 0 END"
            )
        parts.append(f"SELECT dataset, col, pos, '{role}' AS role, {score} AS score FROM prof")
    chosen = lambda name: "CASE " + name + " " + " ".join(
        f"WHEN '{c}' THEN {src.number_sql(q(c))}" for c in DATA
    ) + " END"
    corr = " UNION ALL ".join(
        f"SELECT dataset, '{c}' AS col, count(*) AS n, stddev_pop(v) AS sv, stddev_pop(calc) AS sc, "
        f"covar_pop(v, calc) AS cv FROM (SELECT dataset, calc, {src.number_sql(q(c))} AS v FROM paired) "
        "WHERE v IS NOT NULL AND calc IS NOT NULL GROUP BY dataset"
        for c in DATA
    )
    return _quality_ctes(holes) + f""",
values2 AS (SELECT dataset, col, v, count(*) AS n FROM ({long}) GROUP BY dataset, col, v),
prof AS (SELECT dataset, col, CASE col {position} END AS pos, cast(sum(n) AS bigint) AS rows_,
  cast(sum(n) FILTER (v IS NOT NULL) AS bigint) AS nn, count(v) AS dv,
  CASE WHEN bool_and({strict}) FILTER (v IS NOT NULL) THEN 0
       ELSE coalesce(sum(n) FILTER (({src.date_sql('v')}) IS NOT NULL), 0) / sum(n) END AS dr,
  coalesce(sum(n) FILTER ({src.number_sql('v')} IS NOT NULL), 0) / sum(n) AS rr
  FROM values2 GROUP BY dataset, col HAVING sum(n) FILTER (v IS NOT NULL) > 0),
cand AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE score > 0),
pq AS (SELECT dataset, max(col) FILTER (role = 'price') AS p, max(col) FILTER (role = 'quantity') AS qty FROM
  (SELECT *, row_number() OVER (PARTITION BY dataset, role ORDER BY score DESC, pos) AS rn FROM cand
   WHERE role IN ('price', 'quantity')) WHERE rn = 1 GROUP BY dataset),
paired AS (SELECT dedup.*, {chosen('p')} * {chosen('qty')} AS calc FROM dedup JOIN pq USING (dataset)),
bonus AS (SELECT dataset, col, CASE WHEN n >= 3 AND sv > 0 AND sc > 0
  THEN round(greatest(0, least(0.2, cv / (sv * sc) * 0.2)), 4) ELSE 0 END AS bonus FROM ({corr})),
lifted AS (SELECT c.dataset, c.col, c.pos, c.role, CASE WHEN role = 'revenue'
  THEN least(1, score + coalesce(bonus, 0)) ELSE score END AS score
  FROM cand c LEFT JOIN bonus b ON c.dataset = b.dataset AND c.col = b.col),
first AS (SELECT *, row_number() OVER (PARTITION BY dataset, role ORDER BY score DESC, pos) AS rn FROM lifted
  WHERE role <> 'region'),
cat AS (SELECT dataset, col AS cat FROM first WHERE role = 'category' AND rn = 1),
reg AS (SELECT l.*, row_number() OVER (PARTITION BY l.dataset ORDER BY score DESC, pos) AS rn
  FROM lifted l LEFT JOIN cat ON l.dataset = cat.dataset
  WHERE role = 'region' AND l.col IS DISTINCT FROM cat.cat),
best AS (SELECT dataset, col, role, score FROM first WHERE rn = 1
  UNION ALL SELECT dataset, col, role, score FROM reg WHERE rn = 1),
detected AS (SELECT dataset, {', '.join(f"max(col) FILTER (role = '{r}') AS {r}_col" for r in schema.ROLES)},
  {', '.join(f"coalesce(max(score) FILTER (role = '{r}'), 0) AS {r}_score" for r in schema.ROLES)}
  FROM best GROUP BY dataset),
conf AS (SELECT *, round(date_score * 0.4 + revenue_score * 0.4 + category_score * 0.1 + region_score * 0.1, 4)
  AS confidence FROM detected)
"""


# --- messy sales: queries -----------------------------------------------------------


def column_rules(spark, folder):
    raw = src.raw_sales(spark, folder, True)
    return clean.column_rules(clean.raw_state(raw, KEY), KEY).select("dataset", F.explode("rules").alias("column", "rule"))


def cleaned_rows(spark, folder):
    out = clean.clean(src.raw_sales(spark, folder, True), KEY)
    return out.select(
        "dataset", F.col("_pos").alias("first_pos"), F.col("_copies").alias("copies"),
        F.col("`order date`").alias("order_date"), F.col("`net revenue`").alias("net_revenue"),
        F.col("`product category`").alias("category"), "region",
        F.col("price").cast("double").alias("price"), F.col("quantity").cast("bigint").alias("quantity"),
    )


CLEANED_SQL = f"""WITH {_clean_ctes(True)}
SELECT dataset, _pos AS first_pos, copies, "order date" AS order_date, "net revenue" AS net_revenue,
  "product category" AS category, region, cast(price AS double) AS price, cast(quantity AS bigint) AS quantity
FROM dedup"""


def duplicates(spark, folder):
    return clean.duplicate_summary(clean.clean(src.raw_sales(spark, folder, False), KEY), KEY)


def duplicate_documents(spark, folder):
    """Exact copies among whole texts, per source, after white-space normalisation."""
    whole = text.normalize_text("text")
    # Only counts are asked for: a digest and the length stand for the text in the shuffle.
    rows = src.table(spark, folder, "documents").select(
        "source", "lang", F.sha2(whole, 256).alias("digest"), F.length(whole).alias("size")
    )
    return clean.duplicate_summary(clean.drop_duplicates(rows, ["source"]), ["source"])


DUP_DOCS_SQL = f"""WITH d AS (SELECT source, lang, {src.norm_sql('text')} AS t FROM documents),
g AS (SELECT source, lang, t, count(*) AS n FROM d GROUP BY ALL)
SELECT source, cast(sum(n) AS bigint) AS row_count_before_cleaning, count(*) AS row_count_after_cleaning,
  cast(sum(n) - count(*) AS bigint) AS duplicate_rows, round((sum(n) - count(*)) / sum(n), 4) AS duplicate_percent
FROM g GROUP BY source"""


_LONG_ID = (
    "CASE WHEN o_orderkey % 3 = 0 THEN '{plus}000' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 "
    "THEN '12345678901234567890123' ELSE '1234567890123456' END || cast(100 + floor(o_orderkey / 2) % 500 AS {whole})"
)


def long_ids(spark, folder):
    """Whole numbers of 19 to 26 digits, some with sign and leading zeros, stay apart."""
    ref = _LONG_ID.format(plus="+", whole="int").replace("cast(100", "cast(cast(100").replace("AS int)", "AS int) AS string)")
    rows = src.table(spark, folder, "orders").selectExpr("o_orderpriority AS dataset", ref + " AS ref")
    return clean.clean(rows, KEY).select("dataset", "ref", F.col("_copies").alias("copies"))


LONG_IDS_SQL = f"""SELECT o_orderpriority AS dataset, CASE WHEN o_orderkey % 5 = 0 THEN '12345678901234567890123'
  ELSE '1234567890123456' END || cast(100 + (o_orderkey // 2) % 500 AS varchar) AS ref, count(*) AS copies
FROM orders GROUP BY ALL"""


def column_quality(spark, folder):
    out = quality.column_quality(clean.clean(src.raw_sales(spark, folder, True), KEY), KEY)
    return out


def quality_report(spark, folder):
    out = quality.quality_report(clean.clean(src.raw_sales(spark, folder, True), KEY), KEY)
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select(
        "dataset", "duplicate_rows", "duplicate_percent", total("missing_values").alias("missing"),
        total("invalid_numeric").alias("invalid"), "negative_revenue", "quality_score",
        "row_count_before_cleaning", "row_count_after_cleaning",
    )


def _status(holes):
    def run(spark, folder):
        status = prepare(src.raw_sales(spark, folder, holes), KEY).status
        return status.select(
            "dataset", "status", "reason", "confidence", F.array_join("warnings", "|").alias("warnings"),
            F.array_join("missing_critical_fields", ",").alias("missing_fields"), "quality_score",
        )

    return run


def _status_sql(holes):
    fields = {
        role: "CASE " + f"{role}_col " + " ".join(
            f"WHEN '{c}' THEN {(src.date_sql if role == 'date' else src.number_sql)(q(c))}" for c in DATA
        ) + " END"
        for role in ("date", "revenue")
    }
    return f"""WITH {_schema_ctes(holes)},
crit AS (SELECT d.dataset, count(*) FILTER ({fields['date']} IS NULL) AS nd,
  count(*) FILTER ({fields['revenue']} IS NULL) AS nr FROM dedup d JOIN detected USING (dataset) GROUP BY d.dataset),
j AS (SELECT r.*, c.confidence AS conf, nd, nr, (pct > 0.1 OR score < 0.75) AS early,
  c.confidence < 0.8 AS low, (nd > 0 OR nr > 0) AS incomplete
  FROM report r JOIN conf c USING (dataset) JOIN crit USING (dataset)),
k AS (SELECT *, CASE WHEN early THEN '{fixed.REASON_QUALITY}' WHEN low THEN '{fixed.REASON_SCHEMA}'
  WHEN incomplete THEN '{fixed.REASON_QUALITY}' END AS reason, CASE WHEN early THEN NULL ELSE conf END AS seen FROM j)
SELECT dataset, CASE WHEN reason IS NULL THEN 'success' ELSE 'failed' END AS status, reason,
  coalesce(seen, score) AS confidence, array_to_string(list_filter([
    CASE WHEN pct > 0.1 THEN '{fixed.WARN_DUPLICATES_HIGH}' WHEN pct > 0 THEN '{fixed.WARN_DUPLICATES}' END,
    CASE WHEN negative > 0 THEN '{fixed.WARN_NEGATIVE}' END,
    CASE WHEN coalesce(seen, 0) < 0.85 THEN '{fixed.WARN_LOW_CONFIDENCE}' END], lambda x: x IS NOT NULL), '|') AS warnings,
  CASE WHEN NOT early AND NOT low AND incomplete THEN array_to_string(list_filter([
    CASE WHEN nd > 0 THEN 'date' END, CASE WHEN nr > 0 THEN 'revenue' END], lambda x: x IS NOT NULL), ',')
  END AS missing_fields, score AS quality_score FROM k"""


def _detected(spark, folder):
    return clean.clean(src.raw_sales(spark, folder, False), KEY)


def column_profile(spark, folder):
    return profile.profile(_detected(spark, folder), KEY).select(
        "dataset", "column", "pos", "rows", "non_null", "distinct",
        F.round("date_ratio", 4).alias("date_ratio"), F.round("number_ratio", 4).alias("number_ratio"),
    )


def profile_report(spark, folder):
    out = profile.profile_report(_detected(spark, folder), KEY)
    return out.select(
        "dataset", "column", "semantic_type", "non_null_ratio", "distinct_ratio",
        F.array_join("sample_values", "|").alias("samples"),
    )


_SAMPLES = " UNION ALL ".join(
    f"SELECT dataset, '{c}' AS col, string_agg(v, '|' ORDER BY _pos) AS samples FROM (SELECT dataset, _pos, {q(c)} AS v, "
    f"row_number() OVER (PARTITION BY dataset ORDER BY _pos) AS rn FROM dedup WHERE {q(c)} IS NOT NULL) "
    "WHERE rn <= 3 GROUP BY dataset"
    for c in DATA
)
PROFILE_REPORT_SQL = f"""WITH {_schema_ctes(False)}, samples AS ({_SAMPLES})
SELECT dataset, p.col AS column, CASE WHEN dr >= 0.6 THEN 'date' WHEN rr >= 0.7 THEN 'number' ELSE 'string' END
  AS semantic_type, round(nn / rows_, 3) AS non_null_ratio, round(dv / nn, 3) AS distinct_ratio,
  samples FROM prof p JOIN samples s USING (dataset, col)"""


def role_scores(spark, folder):
    return schema.role_scores(profile.profile(_detected(spark, folder), KEY), KEY)


def best_roles(spark, folder):
    """Best column per role before the category column is taken from region."""
    scores = schema.role_scores(profile.profile(_detected(spark, folder), KEY), KEY)
    return schema.best(scores, KEY)


def consistency(spark, folder):
    rows = _detected(spark, folder)
    pair = rows.select("dataset").distinct().select(
        "dataset", F.lit("price").alias("price_col"), F.lit("quantity").alias("quantity_col")
    )
    return schema.consistency_bonus(rows, pair, KEY)


_NUM = {c: src.number_sql(q(c)) for c in DATA}
CONSISTENCY_SQL = f"""WITH {_clean_ctes(False)},
p AS (SELECT *, {_NUM['price']} * {_NUM['quantity']} AS calc FROM dedup),
c AS ({' UNION ALL '.join(
    f"SELECT dataset, '{c}' AS col, count({_NUM[c]}) AS n, stddev_pop({_NUM[c]}) AS sv, "
    f"stddev_pop(calc) FILTER ({_NUM[c]} IS NOT NULL) AS sc, covar_pop({_NUM[c]}, calc) AS cv "
    "FROM p WHERE calc IS NOT NULL GROUP BY dataset" for c in DATA)})
SELECT dataset, col AS column, CASE WHEN n >= 3 AND sv > 0 AND sc > 0
  THEN round(greatest(0, least(0.2, cv / (sv * sc) * 0.2)), 4) ELSE 0.0 END AS bonus FROM c"""


def detect(spark, folder):
    out = schema.detect_schema(_detected(spark, folder), KEY)
    return out.select(
        "dataset", *[f"{r}_col" for r in schema.ROLES], "confidence",
        *[F.col("column_confidence")[r].alias(f"{r}_confidence") for r in ("date", "revenue", "category", "region")],
    )


DETECT_SQL = f"""WITH {_schema_ctes(False)} SELECT dataset, {', '.join(f'{r}_col' for r in schema.ROLES)}, confidence,
  date_score AS date_confidence, revenue_score AS revenue_confidence, category_score AS category_confidence,
  region_score AS region_confidence FROM conf"""


def payload(spark, folder):
    rows = _detected(spark, folder)
    out = schema.schema_payload(schema.detect_schema(rows, KEY), rows, KEY)
    return out.select(
        "dataset", "date_col", "revenue_col", "category_col", "region_col", "confidence", "row_count",
        F.array_join("columns", "|").alias("columns"),
    )


PAYLOAD_SQL = f"""WITH {_schema_ctes(False)}
SELECT dataset, date_col, revenue_col, category_col, region_col, confidence, after AS row_count,
  'order date|net revenue|product category|region|price|quantity|date|revenue|category' AS columns
FROM conf JOIN report USING (dataset)"""


def canonical(spark, folder):
    rows = _detected(spark, folder)
    found = schema.detect_schema(rows, KEY)
    return canonicalize(rows, found, KEY).select(
        "dataset", F.col("_pos").alias("first_pos"), F.to_date("date").alias("date"), "revenue", "category",
        "region", F.round("price", 4).alias("price"), "quantity",
    )


def _canonical_sql(where=""):
    def pick(role, read):
        return f"CASE {role}_col " + " ".join(f"WHEN '{c}' THEN {read(q(c))}" for c in DATA) + " END"

    return f"""WITH {_schema_ctes(False)}
SELECT dataset, _pos AS first_pos, cast({pick('date', src.date_sql)} AS date) AS date,
  {pick('revenue', src.number_sql)} AS revenue, {pick('category', src.label_sql)} AS category,
  {pick('region', src.label_sql)} AS region, round({pick('price', src.number_sql)}, 4) AS price,
  {pick('quantity', src.number_sql)} AS quantity FROM dedup JOIN conf USING (dataset)"""


def single_dataset(spark, folder):
    """The whole messy table as one dataset: status and roles in one row."""
    raw = src.raw_sales(spark, folder, False).drop("dataset")
    done = prepare(raw)
    return attach(done.status, done.schema.drop("confidence"), []).select(
        "status", "reason", "confidence", "quality_score", "duplicate_rows", "row_count_after_cleaning",
        "date_col", "revenue_col", "category_col", "region_col", "price_col", "quantity_col",
    )


def _single_sql():
    sql = _schema_ctes(False).replace("SELECT id * 2 + copy AS _pos, dataset,", "SELECT id * 2 + copy AS _pos, 0 AS dataset,")
    return f"""WITH {sql} SELECT 'success' AS status, cast(NULL AS varchar) AS reason, confidence,
  score AS quality_score, dup AS duplicate_rows, after AS row_count_after_cleaning, date_col, revenue_col,
  category_col, region_col, price_col, quantity_col FROM report JOIN conf USING (dataset)"""


# --- display rules and stores ---------------------------------------------------------

_SCORED = "c_custkey", "round((c_custkey % 107) / 100.0D - 0.03D, 2) AS score", "c_custkey % 3 AS n_warnings"


def bands(spark, folder):
    rows = src.table(spark, folder, "customer").selectExpr(*_SCORED)
    s = F.col("score")
    return rows.select(
        "c_custkey", quality.quality_band(s, F.col("n_warnings")).alias("band"),
        quality.confidence_label(s).alias("label"), quality.whole_percent(s).alias("percent"),
        quality.quality_gate(F.round(s / 5, 4), s).alias("passes"), quality.schema_gate(s).alias("schema_ok"),
    )


BANDS_SQL = """WITH c AS (SELECT c_custkey, round((c_custkey % 107) / 100.0::DOUBLE - 0.03, 2) AS s, c_custkey % 3 AS n
  FROM customer)
SELECT c_custkey, CASE WHEN n > 0 AND s < 0.8 THEN 'risk' WHEN n > 0 OR s < 0.95 THEN 'warn' ELSE 'good' END AS band,
  CASE WHEN s >= 0.9 THEN 'High' WHEN s >= 0.8 THEN 'Good' WHEN s >= 0.65 THEN 'Moderate' ELSE 'Low' END AS label,
  cast(greatest(0, least(100, floor(s * 100 + 0.5))) AS integer) AS percent,
  round(s / 5, 4) <= 0.1 AND s >= 0.75 AS passes, s >= 0.8 AS schema_ok FROM c"""

_WARN = (
    "CASE event_id % 4 WHEN 0 THEN 'Unable to reach Ollama at host' WHEN 1 THEN 'Dataset quality score is 0.9' "
    "WHEN 2 THEN '' ELSE 'Late ' || event_type END"
)


def shown_warnings(spark, folder):
    rows = src.table(spark, folder, "events").selectExpr("event_id", f"array({_WARN}, 'Check ' || event_type) AS w")
    return rows.select("event_id", F.array_join(quality.display_warnings(F.col("w")), "|").alias("warnings"))


SHOWN_SQL = f"""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'Late ' || event_type || '|' ELSE '' END
  || 'Check ' || event_type AS warnings FROM (SELECT event_id, event_type, {_WARN} AS w FROM events)"""


def preview(spark, folder):
    rows = src.orders(spark, folder).withColumnRenamed("id", "_pos")
    return csvs.preview(rows, ["segment"]).select("segment", F.col("_pos").alias("id"), "date", "revenue")


PREVIEW_SQL = """SELECT segment, id, strftime(d, '%Y-%m-%d') AS date, v AS revenue FROM (
  SELECT o_orderkey AS id, o_orderdate AS d, o_totalprice AS v, o_orderpriority AS segment,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 8"""


def records_roundtrip(spark, folder):
    """Records as stored (text dates, loose numbers, raw labels) read back typed."""
    rows = src.sales(spark, folder).selectExpr(
        "id", "date", "CASE WHEN id % 6 = 0 THEN double('NaN') ELSE revenue END AS revenue",
        "lower(category) AS category", "'  ' || region AS region",
    )
    back = store.restore_types(csvs.with_text_dates(rows))
    return back.select("id", F.to_date("date").alias("date"), "revenue", "category", "region")


RECORDS_SQL = f"""SELECT id, cast(d AS date) AS date, CASE WHEN id % 6 <> 0 THEN v END AS revenue,
  {src.label_sql('category')} AS category, {src.label_sql('region')} AS region FROM ({src.SALES_SQL})"""

_ID = (
    "CASE event_id % 4 WHEN 0 THEN substr(md5(cast(event_id AS {t})), 1, 12) "
    "WHEN 1 THEN ' ' || upper(substr(md5(cast(event_id AS {t})), 1, 12)) || ' ' "
    "WHEN 2 THEN substr(md5(cast(event_id AS {t})), 1, 11) ELSE '../' || event_type END"
)


def report_ids(spark, folder):
    rows = src.table(spark, folder, "events").selectExpr("event_id", _ID.format(t="string") + " AS r")
    return rows.select("event_id", store.clean_report_id(F.col("r")).alias("report_id"))


REPORT_IDS_SQL = f"""SELECT event_id, CASE WHEN regexp_full_match(lower(trim(r)), '[a-f0-9]{{12}}') THEN lower(trim(r)) END
  AS report_id FROM (SELECT event_id, {_ID.format(t='varchar')} AS r FROM events)"""

QUERIES = {
    "parse_numeric": (parse_numeric, PARSE_NUMERIC_SQL),
    "parse_dates": (parse_dates, PARSE_DATES_SQL),
    "title_labels": (
        title_labels, f"SELECT p_partkey, {src.label_sql('t')} AS label FROM (SELECT p_partkey, {_LABEL} AS t FROM part)"
    ),
    "normalize_documents": (
        normalize_documents,
        f"SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM (SELECT doc_id, {src.norm_sql('text')} AS t FROM documents)",
    ),
    "blank_mask": (
        blank_mask,
        f"SELECT c_custkey, {src.norm_sql('t')} IS NULL AS blank FROM (SELECT c_custkey, {_BLANK} AS t FROM customer)",
    ),
    "null_tokens": (
        null_tokens,
        f"SELECT event_id, CASE WHEN event_id % 7 IN (2, 5, 6) THEN t END AS value FROM "
        f"(SELECT event_id, {_TOKEN} AS t FROM events)",
    ),
    "header_names": (
        headers,
        'SELECT s_suppkey AS "s suppkey", s_name AS "supplier name", s_nationkey AS "nation key", '
        's_acctbal AS "nation key_1" FROM supplier',
    ),
    "drop_empty": (
        drop_empty,
        "SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END "
        "AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 10 <> 0",
    ),
    "usable_texts": (
        usable_texts,
        "SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN 'empty' WHEN length(trim(text, E' \\t\\n\\r')) > 1000 "
        "THEN 'too long' END AS reject_reason FROM conversations",
    ),
    "column_rules": (
        column_rules, f"WITH {_clean_ctes(True)} SELECT dataset, col AS column, rule FROM rules"
    ),
    "cleaned_rows": (cleaned_rows, CLEANED_SQL),
    "duplicate_rate": (
        duplicates,
        f"WITH {_quality_ctes(False)} SELECT dataset, before AS row_count_before_cleaning, after AS "
        "row_count_after_cleaning, dup AS duplicate_rows, pct AS duplicate_percent FROM dups",
    ),
    "duplicate_documents": (duplicate_documents, DUP_DOCS_SQL),
    "long_ids": (long_ids, LONG_IDS_SQL),
    "column_quality": (
        column_quality,
        f"WITH {_quality_ctes(True)} SELECT dataset, col AS column, rows_ AS rows, missing, ok AS numeric, invalid, "
        "cast(negative AS bigint) AS negative, candidate FROM colq",
    ),
    "quality_report": (
        quality_report,
        f"WITH {_quality_ctes(True)} SELECT dataset, dup AS duplicate_rows, pct AS duplicate_percent, missing, invalid, "
        "negative AS negative_revenue, score AS quality_score, before AS row_count_before_cleaning, "
        "after AS row_count_after_cleaning FROM report",
    ),
    "gate_status_with_holes": (_status(True), _status_sql(True)),
    "gate_status": (_status(False), _status_sql(False)),
    "column_profile": (
        column_profile,
        f"WITH {_schema_ctes(False)} SELECT dataset, col AS column, pos, rows_ AS rows, nn AS non_null, dv AS distinct, "
        "round(dr, 4) AS date_ratio, round(rr, 4) AS number_ratio FROM prof",
    ),
    "profile_report": (profile_report, PROFILE_REPORT_SQL),
    "role_scores": (
        role_scores, f"WITH {_schema_ctes(False)} SELECT dataset, role, col AS column, pos, score FROM cand"
    ),
    "best_roles": (
        best_roles,
        f"WITH {_schema_ctes(False)} SELECT dataset, role, col AS column, score FROM (SELECT *, row_number() OVER "
        "(PARTITION BY dataset, role ORDER BY score DESC, pos) AS rn FROM cand) WHERE rn = 1",
    ),
    "revenue_consistency": (consistency, CONSISTENCY_SQL),
    "detect_schema": (detect, DETECT_SQL),
    "schema_payload": (payload, PAYLOAD_SQL),
    "canonical_rows": (canonical, _canonical_sql()),
    "prepare_single_dataset": (single_dataset, _single_sql()),
    "quality_bands": (bands, BANDS_SQL),
    "display_warnings": (shown_warnings, SHOWN_SQL),
    "preview_rows": (preview, PREVIEW_SQL),
    "records_roundtrip": (records_roundtrip, RECORDS_SQL),
    "report_ids": (report_ids, REPORT_IDS_SQL),
}
