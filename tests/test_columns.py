"""Column state: exact counts whatever the sketch holds."""

import pytest
from pyspark.sql import functions as F

from trustkpi.operators import clean, column_state, profile


@pytest.fixture(params=[13, 4])
def sketch_bits(request, monkeypatch):
    """With 16 values to a sketch most columns need the second pass."""
    monkeypatch.setattr(column_state, "SKETCH_BITS", request.param)
    return request.param


def table(spark):
    return spark.range(400).select(
        F.col("id").alias("_pos"), F.concat(F.lit("d"), F.col("id") % 2).alias("ds"),
        F.concat(F.lit("w "), F.col("id") % 40).alias("words"), F.concat(F.lit("t "), F.col("id")).alias("texts"),
        F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("string")).alias("whole"),
        F.when(F.col("id") % 2 == 1, "TRUE").otherwise(F.when(F.col("id") < 2, " ")).alias("flags"),
        F.lit(None).cast("string").alias("nothing"),
    )


def test_rules_and_presence(spark, sketch_bits):
    state = clean.raw_state(table(spark), ["ds"])
    rules = {r.ds: r.rules for r in clean.column_rules(state, ["ds"]).collect()}
    # 40 words: 20 of the 200 rows of each dataset, where 40 may be labels.
    assert rules["d0"] == {"words": "label", "texts": "text", "whole": "integer"}
    assert rules["d1"] == {"words": "label", "texts": "text", "whole": "integer", "flags": "boolean"}
    present = {r.ds: sorted(r.present) for r in clean.present_columns(state, ["ds"]).collect()}
    assert present == {"d0": ["flags", "texts", "whole", "words"], "d1": ["flags", "texts", "whole", "words"]}
    single = clean.column_rules(clean.raw_state(table(spark).drop("ds"))).first().rules
    assert single["words"] == "label" and single["texts"] == "text"


def test_distinct_counts_are_exact(spark, sketch_bits):
    rows = table(spark).drop("_pos").withColumn("_copies", F.lit(1))
    got = {(r.ds, r.column): r for r in profile.profile(rows, ["ds"]).collect()}
    assert {c: got["d0", c].distinct for c in ("words", "texts", "whole")} == {"words": 20, "texts": 200, "whole": 7}
    assert got["d0", "flags"].distinct == 1 and ("d0", "nothing") not in got
    assert [got["d1", c].pos for c in ("words", "texts", "whole", "flags")] == [0, 1, 2, 3]
    assert got["d1", "whole"].number_ratio == got["d1", "whole"].non_null / 200


def test_places_may_differ_between_datasets(spark):
    rows = table(spark).select("ds", "words", "texts").withColumn("_copies", F.lit(1))
    order = spark.createDataFrame([("d0", "texts", 0), ("d0", "words", 1), ("d1", "words", 0), ("d1", "texts", 1)], "ds string, column string, pos int")
    got = {(r.ds, r.column): r.pos for r in profile.profile(rows, ["ds"], order).collect()}
    assert got == {("d0", "texts"): 0, ("d0", "words"): 1, ("d1", "words"): 0, ("d1", "texts"): 1}


def test_samples_are_the_first_values(spark):
    rows = table(spark).withColumn("_copies", F.lit(1))
    got = {(r.ds, r.column): r.sample_values for r in profile.samples(rows, ["ds"], ["texts", "whole", "nothing"]).collect()}
    assert got == {("d0", "texts"): ["t 0", "t 2", "t 4"], ("d1", "texts"): ["t 1", "t 3", "t 5"],
                   ("d0", "whole"): ["2", "4", "1"], ("d1", "whole"): ["1", "5", "0"]}


def test_counts_are_staged_and_read_only_open_columns(spark, monkeypatch):
    monkeypatch.setattr(column_state, "SKETCH_BITS", 4)
    rows, asked = table(spark), []
    state = column_state.column_state(column_state.long_rows(rows, ["ds"], ["texts", "whole"]), ["ds"], [])

    def cells(names):
        asked.append(names)
        return column_state.long_rows(rows, ["ds"], names)

    got = column_state.with_distinct(state, cells, ["ds"], F.lit(True))
    assert asked == [["texts"]]
    # Rules and presence both read the counts: neither may count the digests again.
    assert "md5" not in got._jdf.queryExecution().toString()
    assert {(r.ds, r.column): r.distinct for r in got.collect()}["d1", "texts"] == 200
