"""Registered queries over the whole tables of the smallest scale against brute force."""

from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from test_filters import brute_overlap, brute_secrets, brute_statistics
from test_near_duplicates import brute_components, brute_repeats
from test_personal_data import PATTERNS, brute_base

from trustkpi.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
KINDS = ["email", "ip", "card", "phone"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


def run(spark, name, *columns):
    found = QUERIES[name][0](spark, FOLDER)
    return sorted(tuple(r) for r in found.select(*(columns or found.columns)).collect())


def test_secrets(spark, docs):
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert run(spark, "op1_secret_scan", *names) == sorted((d, *brute_secrets(t)) for d, t in docs)


def test_quality_base(spark, docs):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for doc, text in docs:
        stats = brute_statistics(text)
        want.append((doc, *stats, stats[0] < 50 or 100 * stats[4] > 50 * stats[0]))
    assert run(spark, "op3_quality_rules", *names) == sorted(want)
    assert not [r for r in run(spark, "op3_quality_rules", "base_failed", "kept") if all(r)]


def test_decontamination(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert run(spark, "op4_decontamination", *names) == sorted((d, *brute_overlap(t, items)) for d, t in docs)


def test_chat(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    probe = "<|im_end|><|im_start|>assistant ok"
    turns = defaultdict(list)
    for conv, turn, role, text in [*map(tuple, rows), (-1, 0, "user", probe), (-1, 1, "assistant", probe)]:
        turns[conv].append((turn, role or "", text or ""))
    want = []
    for conv, listed in turns.items():
        listed.sort()
        loss = "".join(t for _, r, t in listed if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in listed)
        want.append((conv, len(listed), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()))
    assert run(spark, "op7_chat_format", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want)


def test_repeats(spark, docs):
    assert run(spark, "op8_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute_repeats(docs))


def test_near_duplicates(spark, docs):
    assert run(spark, "op10_simhash", "doc_id", "fingerprint", "component_id") == sorted(brute_components(docs))


def test_personal_data(spark, docs):
    want = []
    for doc, text in docs:
        spans = brute_base(text)
        count = Counter(k for _, k, _ in spans)
        shown = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((doc, *(count[k] for k in range(len(PATTERNS))), sha256(shown.encode()).hexdigest()))
    names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert run(spark, "op13_personal_data", *names) == sorted(want)
