"""CSV scans: every column as text, clean unique headers, null tokens as NULL."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustkpi.functions.text import null_tokens_to_null
from trustkpi.operators.clean import POSITION, unique_headers
from trustkpi.operators.keyed import cols
from trustkpi.session import stage

_RAW_LINE = "_raw_line"
# Each distinct header is a scan of its own in the plan.
MOST_HEADERS = 500
# One field: quoted text with doubled quotes, or anything without a comma.
_FIELD = r'(?s)(?:^|,)(?:"(?:[^"]|"")*"|[^,]*)'


def scan_headers(names: list[str]) -> list[str]:
    """Names as a CSV scan gives them: blanks become ``Unnamed: n``, repeats get ``.1``, ``.2``."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = name if name != "" else f"Unnamed: {i}"
        candidate, k = base, 0
        while candidate in out:
            k += 1
            candidate = f"{base}.{k}"
        out.append(candidate)
    return out


def header_names(line: str) -> list[str]:
    """Clean unique column names from a header line."""
    return unique_headers(scan_headers(next(csv.reader([line.lstrip("\ufeff")]))))


@dataclass(frozen=True)
class CsvFiles:
    """The files under a path, each known by its own header.

    ``found`` has one row per file: ``path``, ``header`` (its first line that is not blank, NULL if there is
    none) and ``lines`` (the others). ``scans`` lists each distinct list of names with its files: the
    driver holds file names, as the listing of any scan does.
    """

    found: DataFrame
    headers: DataFrame
    scans: list[tuple[list[str], list[str]]]

    def rows(self, key: str | None = None, multiline: bool = False, surplus: str = "fail") -> DataFrame:
        """Text rows with ``_pos`` and, when ``key`` is given, the file's full path as that column.

        Each distinct header is one scan; a column that a file lacks is NULL in its rows. Without
        ``key`` all files are one dataset and must have the same columns in the same order. Short rows are
        padded with NULL. Rows with more fields than their header stop the job, or are left
        out with ``surplus="drop"`` (see ``surplus_rows``). ``multiline`` allows line breaks inside quotes but
        makes a file one task.
        """
        if not self.scans:
            raise ValueError("no file has a header line")
        if key is None and len(self.scans) > 1:
            shown = "; ".join(", ".join(names) for names, _ in self.scans[:3])
            raise ValueError(f"files of one dataset have different headers: {shown}")
        if len(self.scans) > MOST_HEADERS:
            raise ValueError(f"{len(self.scans)} different headers, at most {MOST_HEADERS} are read at once")
        if any({key, POSITION, _RAW_LINE} & set(names) for names, _ in self.scans):
            raise ValueError(f"a header has a column that is called {key}, {POSITION} or {_RAW_LINE}")
        parts = [_scan(self.found.sparkSession, names, paths, key, multiline, surplus) for names, paths in self.scans]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def datasets(self, key: str) -> DataFrame:
        """(key) of every file, also of those without a usable row: what ``prepare`` takes as expected."""
        return self.found.select(F.col("path").alias(key))

    def columns(self, key: str) -> DataFrame:
        """(key, column, pos): the place of each column in its file."""
        named = self.found.join(self.headers, "header")
        return named.select(F.col("path").alias(key), F.posexplode("names").alias("pos", "column"))

    def without_rows(self, rows: DataFrame, key: str) -> DataFrame:
        """Files that give no row: empty ones, those with a header only, and those whose rows are all surplus."""
        return self.found.join(rows.select(F.col(f"`{key}`").alias("path")).distinct(), "path", "left_anti")


def list_files(spark: SparkSession, path: str | list[str]) -> CsvFiles:
    """Headers and line counts of all files, from one pass over their lines; empty files come from the listing."""
    text = spark.read.text(path)
    # A scan leaves empty files out, its listing does not.
    names = {re.sub("^file:/+", "file:/", unquote(p)) for p in text.inputFiles()}
    listed = spark.createDataFrame([(p,) for p in sorted(names)], "path string")
    lines = text.select(
        "value", _file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    heads = lines.where(F.trim("value") != "").groupBy("path").agg(
        F.min_by("value", F.struct("block", "at")).alias("header"), (F.count(F.lit(1)) - 1).alias("lines")
    )
    found = stage(listed.join(heads, "path", "left").withColumn("lines", F.coalesce("lines", F.lit(0))), "files")
    texts = [r.header for r in found.where("header IS NOT NULL").select("header").distinct().orderBy("header").collect()]
    names = {text: header_names(text) for text in texts}
    headers = spark.createDataFrame([(t, n) for t, n in names.items()], "header string, names array<string>")
    scans: dict[tuple, list[str]] = {}
    for row in found.where("header IS NOT NULL").orderBy("path").collect():
        scans.setdefault(tuple(names[row.header]), []).append(row.path)
    return CsvFiles(found, headers, [(list(n), paths) for n, paths in scans.items()])


def _file_path() -> Column:
    """Full path of a row's file as the listing spells it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def field_count(line: Column) -> Column:
    return F.size(F.regexp_extract_all(line, F.lit(_FIELD), 0))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    key: str | None = None,
    multiline: bool = False,
    surplus: str = "fail",
) -> DataFrame:
    """Rows of the files under ``path``: see ``CsvFiles.rows``."""
    return list_files(spark, path).rows(key, multiline, surplus)


def surplus_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line): raw lines that hold more fields than the header of their file."""
    files = list_files(spark, path)
    width = files.found.join(files.headers, "header").select("path", F.size("names").alias("width"))
    lines = spark.read.text(path).select(_file_path().alias("path"), F.col("value").alias("line"))
    return lines.join(width, "path").where(field_count(F.col("line")) > F.col("width")).select("path", "line")


def _too_long(names: list[str]) -> Column:
    # Short rows are reported as corrupt too; only longer ones are an error. The
    # always-true second test names a data column: a scan may not ask for the
    # raw line alone, as a plain count would.
    surplus = F.coalesce(field_count(F.col(_RAW_LINE)) > len(names), F.lit(False))
    return surplus & F.coalesce(F.length(F.col(f"`{names[-1]}`")) >= 0, F.lit(True))


def _scan(
    spark: SparkSession, names: list[str], paths: list[str], key: str | None, multiline: bool, surplus: str
) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RAW_LINE]])
    scanned = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RAW_LINE)
        .option("escape", '"')
        .option("multiLine", multiline)
        # Every line is read in full, so the field count never depends on the query.
        .option("columnPruning", False)
        # A path names one file, whatever signs it holds.
        .csv([re.sub(r"([][{}*?\\])", r"\\\1", p) for p in paths])
    )
    source = [_file_path().alias(key)] if key else []
    rows = scanned.select(F.monotonically_increasing_id().alias(POSITION), *source, *cols([*names, _RAW_LINE]))
    too_long = _too_long(names)
    if surplus == "fail":
        message = F.concat(F.lit("row has more fields than the header: "), F.col(_RAW_LINE))
        rows = rows.where(~F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(False))
    else:
        rows = rows.where(~too_long)
    values = [null_tokens_to_null(F.col(f"`{c}`")).alias(c) for c in names]
    return rows.select(F.col(POSITION), *([F.col(key)] if key else []), *values)


def require_rows(df: DataFrame) -> DataFrame:
    """The same rows, or an error when there are none."""
    if df.isEmpty():
        raise ValueError("there is no row below the header")
    return df


def preview(df: DataFrame, keys=(), limit: int = 8, order: str = POSITION) -> DataFrame:
    """First rows in input order, dates as ``yyyy-MM-dd``."""
    if keys:
        rank = F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(order))
        first = df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
    else:
        first = df.orderBy(order).limit(limit)
    return with_text_dates(first)


def with_text_dates(df: DataFrame) -> DataFrame:
    """Date and timestamp columns as ``yyyy-MM-dd`` text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd").alias(field.name)
        out.append(c)
    return df.select(*out)
