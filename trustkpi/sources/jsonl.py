"""JSON lines of tool-call records and chat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trustkpi.operators.toolcalls import CALL_TYPE, COLUMN_TYPE

EXAMPLE_TYPE = (
    f"id bigint, schema struct<columns:array<{COLUMN_TYPE}>,n_rows:int,"
    "noise_applied:array<string>,sample_file_name:string>, user_query string, "
    f"tool_calls array<{CALL_TYPE}>, category string, difficulty string"
)
CHAT_TYPE = "messages array<struct<role:string,content:string>>, _category string, _difficulty string"
PUBLIC_TYPE = (
    "id bigint, messages array<struct<content:string,role:string,tool_calls:array<struct<type:string,"
    "function:struct<name:string,arguments:string>>>>>, tools string"
)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAMPLE_TYPE).json(path)


def read_chat_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAT_TYPE).json(path)


def read_public(spark: SparkSession, path: str) -> DataFrame:
    """Public function-calling rows a user has downloaded, JSON lines or parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(PUBLIC_TYPE).parquet(path)
    return spark.read.schema(PUBLIC_TYPE).json(path)


def write_rows(df: DataFrame, path: str) -> None:
    """One JSON object per line; with a ``split`` column, one folder per split."""
    writer = df.write.mode("overwrite")
    if "split" in df.columns:
        writer = writer.partitionBy("split")
    writer.json(path)
