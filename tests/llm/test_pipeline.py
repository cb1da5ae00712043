"""The pipeline stage by stage, and the entry module without it."""

import hashlib
import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from trustkpi.llm import classifier, decontamination, simhash

TABLES = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages_keep_columns_and_their_rules(spark, tmp_path):
    base = spark.read.parquet(f"{TABLES}/documents.parquet")
    odd = base.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")).unionByName(base.limit(2)).unionByName(base.limit(2))
    docs = base.unionByName(odd).withColumn("score", F.lit("mine")).withColumn("n_hit", F.lit(3))
    before = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, TABLES)
        out.write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert after.columns == before.columns, name
        if name == "quality_classifier":
            scored = classifier.classify(docs.drop("score"), spark.read.parquet(f"{TABLES}/labels.parquet"))
            assert after.count() == scored.where("predicted = 1").count()
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(docs).select("root").distinct().count()
            assert after.count() == groups and simhash.near_duplicates(after).select("root").distinct().count() == groups
        if name == "benchmark_decontamination":
            marked = decontamination.find_overlaps(docs.drop("n_hit"), spark.read.parquet(f"{TABLES}/benchmark.parquet"))
            assert after.count() == marked.where("NOT contaminated").count()
        docs = after
    sizes = [r.n for r in docs.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1


def test_of_rows_with_one_text_the_least_stays(frame, spark):
    rows = [(None, "same text here now", "b", 1), (None, "same text here now", "a", 2), (7, "other words in this one", "x", 1), (7, "other words in this one", "y", 1),
            (7, "other words in this one", "x", 1), (3, None, "n", 1), (4, "", "e", None)]
    docs = frame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicates(spark, docs, TABLES)
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()), key=str)
    least = {r: hashlib.sha256(f"{json.dumps({k: v for k, v in zip(('doc_id', 'source', 'n_chars'), (r[0], *r[2:])) if v is not None}, separators=(',', ':'))}|".encode()
                               + (hashlib.sha256(r[1].encode()).hexdigest() if r[1] is not None else "null").encode()).hexdigest() for r in rows}
    one, two = (min((r for r in rows if r[1] and r[1].startswith(t)), key=least.get) for t in ("same", "other"))
    assert got == sorted([one, two, rows[5]], key=str)  # no text and an empty one are one group


def test_pipeline_of_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, TABLES).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    assert docs.count() == 0


def test_registry_has_all_queries():
    names = registry.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in names)] == [] and "pipeline" in names


def test_entry_imports_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_bytes((ROOT / name).read_bytes())
    (tmp_path / "trustkpi").mkdir()
    for path in (ROOT / "trustkpi").iterdir():
        if path.name not in ("llm", "__pycache__"):
            (tmp_path / "trustkpi" / path.name).symlink_to(path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 90
