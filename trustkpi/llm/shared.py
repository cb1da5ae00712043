"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one Arrow batch. Long texts would make the default of 10,000 rows heavy.
BATCH_ROWS = 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for whole long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add; names compare without case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def packed(names: list[str]) -> Column:
    """The columns ``names`` in one struct ``_row``: whatever they are called, no name can clash."""
    return F.struct(F.lit(0).alias("_row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("_row")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(names)]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit key of a document row: equal rows share it, also rows with a null id."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("|"), F.col(text_col))


def binary_values(column) -> list:
    """UTF-8 bytes of an Arrow text column, None for null."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def text_map(df: DataFrame, compute, fields: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns ``fields`` that ``compute`` derives from whole texts.

    ``compute`` gets the texts of one batch as UTF-8 bytes (None for null) and returns one
    Arrow array per field. ``keep`` names the columns to carry along (default: all). A
    column that has the name of a new one is replaced.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    added = T.StructType.fromDDL(fields)
    rest = without(df, *added.names) if text_col not in added.names else df
    carried = [c for c in (rest.columns if keep is None else keep) if c not in added.names]
    if text_col in carried:
        source = rest.select(*[F.col(f"`{c}`") for c in carried])
        at = carried.index(text_col)
    else:
        source = rest.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`"))
        at = len(carried)
    names = [*carried, *added.names]

    def run(batches):
        for batch in batches:
            arrays = compute(binary_values(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))), *arrays], names)

    return arrow_map(source, run, T.StructType([*source.schema.fields[: len(carried)], *added.fields]))


# Pieces the rows of one key are dealt to when a value of that key is attached to them.
PIECES = 64


def attach_dealt(rows: DataFrame, values: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``values``, which has at most one row per key ``on``.

    The rows of a key are dealt to ``PIECES`` by the columns ``by``: the values are first joined to
    the pieces that occur, then to the rows of each, so no task gets all rows of a hot key. Keys
    are never null. Stage ``rows`` before: they are read twice.
    """
    dealt = rows.withColumn("_piece", F.pmod(F.xxhash64(*by), F.lit(PIECES)).cast("int"))
    found = dealt.select(*on, "_piece").distinct().join(values.hint("merge"), on)
    return dealt.join(found.hint("merge"), [*on, "_piece"], how).drop("_piece")
