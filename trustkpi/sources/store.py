"""Stored reports and their records.

Each save is a batch of Parquet files, dealt to folders by the first digits of the report id and sorted
by id inside: ``reports/batch=…/bucket=…``, ``records/batch=…/bucket=…``. The files carry the batch's schema, so a
column without any value stays. ``index/bucket=…`` tells the batch of each id and is written last: a report
is found once it and its records are complete. A later save of an id replaces the earlier one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustkpi import fixed
from trustkpi.functions.dates import parse_date
from trustkpi.functions.numbers import parse_number
from trustkpi.functions.text import normalize_label
from trustkpi.operators.keyed import Keys, attach, cols
from trustkpi.session import stage
from trustkpi.sources.csvs import with_text_dates

REPORT_ID = "report_id"
# Folder of a report: the first digits of its id, 256 folders to a batch.
BUCKET, BUCKET_DIGITS = "bucket", 2
_INDEX = f"{REPORT_ID} string, batch string, saved timestamp, {BUCKET} string"
REPORT_TYPE = (
    "report_id string, app_name string, prompt string, share_url string, saved_at string, "
    "data_storage struct<mode:string,raw_csv_stored:boolean>, status string, reason string, "
    "confidence double, quality_score double, duplicate_percent double, date_col string, "
    "revenue_col string, category_col string, region_col string, total_revenue double, "
    "growth_rate double, average_revenue double, "
    "anomalies struct<count:int,dates:array<string>,z_scores:map<string,double>>, "
    "period_count bigint, title string, summary string, "
    "insights array<struct<title:string,body:string,tone:string>>, "
    "story array<struct<id:string,eyebrow:string,headline:string,copy:string,chart_id:string>>, "
    "suggested_questions array<string>, warnings array<string>, row_count bigint"
)


def clean_report_id(value: Column) -> Column:
    """Trimmed lower-case id when it is twelve hex digits, else NULL."""
    text = F.lower(F.trim(value))
    return F.when(text.rlike(fixed.REPORT_ID_PATTERN), text)


def with_report_ids(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Give every dataset an id, keeping given ones.

    The id hashes the keys with one token per call, so a task that runs again
    after a lost executor gives the same id, and rows of one dataset agree.
    """
    token = uuid.uuid4().hex
    parts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\u0000")) for k in keys]
    fresh = F.substring(F.md5(F.concat_ws("|", F.lit(token), *parts)), 1, 12)
    given = clean_report_id(F.col(REPORT_ID)) if REPORT_ID in df.columns else F.lit(None).cast("string")
    return df.withColumn(REPORT_ID, F.coalesce(given, fresh))


def report_envelope(reports: DataFrame, app_name: str, prompt: str) -> DataFrame:
    """Add application name, prompt, share link, save time and storage mode."""
    return reports.select(
        "*",
        F.lit(app_name).alias("app_name"),
        F.lit(prompt).alias("prompt"),
        F.concat(F.lit("/?report="), F.col(REPORT_ID)).alias("share_url"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("saved_at"),
        F.struct(
            F.lit("normalized-json").alias("mode"), F.lit(False).alias("raw_csv_stored")
        ).alias("data_storage"),
    )


def _bucket(report_id: Column) -> Column:
    return F.substring(report_id, 1, BUCKET_DIGITS)


def _write(df: DataFrame, path: str) -> None:
    # REBALANCE groups rows by folder and lets adaptive execution split a hot one.
    placed = df.withColumn(BUCKET, _bucket(F.col(REPORT_ID))).hint("rebalance", BUCKET)
    placed.sortWithinPartitions(BUCKET, REPORT_ID).write.mode("append").partitionBy(BUCKET).parquet(path)


def _writable(df: DataFrame) -> DataFrame:
    """Dates as text, columns of no type as text."""
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    return with_text_dates(df.withColumns({c: F.col(f"`{c}`").cast("string") for c in void}))


def save(reports: DataFrame, path: str, records: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """Store reports, one per dataset, with their records; returns (keys, report_id).

    Both get one id per dataset: the report's own if it has a valid one, else a fresh one. Records are
    matched by ``keys``; those of a dataset without a report are not stored.
    """
    batch = uuid.uuid4().hex
    tagged = stage(with_report_ids(reports, keys), "reports")
    ids = tagged.select(*cols(keys), REPORT_ID)
    _write(_writable(tagged), f"{path}/reports/batch={batch}")
    if records is not None:
        rows = attach(records.drop(REPORT_ID), ids, keys)
        _write(_writable(rows.where(F.col(REPORT_ID).isNotNull())), f"{path}/records/batch={batch}")
    _write(ids.select(REPORT_ID, F.lit(batch).alias("batch"), F.current_timestamp().alias("saved")), f"{path}/index")
    return ids


def _one_id(report_id: str) -> str:
    cleaned = (report_id or "").strip().lower()
    if not re.fullmatch(fixed.REPORT_ID_PATTERN, cleaned):
        raise FileNotFoundError(report_id)
    return cleaned


def _rows_of(spark: SparkSession, path: str, kind: str, report_id: str) -> DataFrame:
    """Rows of one report: one folder of the index and one of its batch are listed, the id is pushed to the scan."""
    wanted = _one_id(report_id)
    folder = f"{BUCKET}={wanted[:BUCKET_DIGITS]}"
    try:
        index = spark.read.schema(_INDEX).option("basePath", f"{path}/index").parquet(f"{path}/index/{folder}")
        found = index.where(F.col(REPORT_ID) == wanted).agg(F.max_by("batch", "saved").alias("batch")).first()
        if found.batch is None:
            raise FileNotFoundError(report_id)
        return spark.read.parquet(f"{path}/{kind}/batch={found.batch}/{folder}").where(F.col(REPORT_ID) == wanted)
    except AnalysisException as exc:
        raise FileNotFoundError(report_id) from exc


def load_report(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    """One stored report row, with the columns it was saved with."""
    return _rows_of(spark, path, "reports", report_id)


def load_records(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    """Typed records of one stored report."""
    return restore_types(_rows_of(spark, path, "records", report_id))


def load_reports(spark: SparkSession, path: str, schema: str = REPORT_TYPE) -> DataFrame:
    """All reports in their latest form, for joins with tables of questions; columns a batch lacks are NULL."""
    rows = spark.read.schema(f"{schema}, batch string, {BUCKET} string").parquet(f"{path}/reports")
    latest = spark.read.schema(_INDEX).parquet(f"{path}/index").groupBy(REPORT_ID).agg(F.max_by("batch", "saved").alias("batch"))
    return rows.join(latest, [REPORT_ID, "batch"]).drop("batch", BUCKET)


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array of records, with the file name as id."""
    rows = spark.read.option("multiLine", True).json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1)
    return restore_types(rows.withColumn(REPORT_ID, name))


def restore_types(records: DataFrame) -> DataFrame:
    """Type the role columns that are present; a stored NaN is a missing value."""
    out = []
    types = dict(records.dtypes)
    for name, kind in types.items():
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.nanvl(c, F.lit(None).cast(kind))
        if name == "date":
            c = parse_date(c.cast("string"))
        elif name in ("revenue", "price", "quantity"):
            c = parse_number(c.cast("string"))
        elif name in ("category", "region"):
            c = normalize_label(c.cast("string"))
        out.append(c.alias(name))
    return records.select(*out)
