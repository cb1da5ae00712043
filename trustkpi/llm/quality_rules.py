"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio.

Byte 3-grams are hashed to ``BUCKETS``. Two multinomials are counted over whole texts: one
over all documents, one over the trusted ones (labelled good). A document's score is the
mean log ratio of its n-grams, so its length does not matter; one threshold decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi.llm.shared import arrow_map, binary_values, text_map
from trustkpi.session import stage

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
# Pseudo n-grams per bucket, trusted in the overall proportion: rare n-grams say little.
PRIOR = 50.0
THRESHOLD = -0.35
MIN_WORDS = 50
WINDOW = 3
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"


def ngram_buckets(text: bytes | None) -> np.ndarray:
    raw = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    code, span = ids[:n], len(numbers)
    for k in range(1, window):
        if int(code.max()) * len(numbers) >= 1 << 62:  # keep the codes exact
            code = np.unique(code, return_inverse=True)[1]
        code = code * span + ids[k : k + n]
    _, place, count = np.unique(code, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[place] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or b""
    words = text.split()
    points = int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    chars = points - sum(text.count(c) for c in _SPACES)
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line.strip():
            repeated += line in seen
            seen.add(line)
    return len(words), chars, sum(text.count(c) for c in _SYMBOLS), repeated, repeated_words(words)


def count_ngrams(docs: DataFrame, trusted: Column, text_col: str = "text") -> DataFrame:
    """(bucket, n_all, n_trusted) over whole texts; each task sends one row per bucket."""

    def run(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = batch.column(1).to_pylist()
            for text, flag in zip(binary_values(batch.column(0)), good):
                found = np.bincount(ngram_buckets(text), minlength=BUCKETS)
                total[0] += found
                if flag:
                    total[1] += found
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "n", "t"]
        )

    rows = docs.select(F.col(text_col), trusted.alias("good"))
    return arrow_map(rows, run, "bucket int, n bigint, t bigint").groupBy("bucket").agg(
        F.sum("n").alias("n_all"), F.sum("t").alias("n_trusted")
    )


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log ratio per bucket; the table has ``BUCKETS`` rows at most, whatever the corpus."""
    both = np.zeros((2, BUCKETS))
    for row in counts.collect():
        both[0][row["bucket"]], both[1][row["bucket"]] = row["n_all"], row["n_trusted"]
    n, trusted = both
    if not trusted.sum():
        return np.zeros(BUCKETS)
    rate = trusted.sum() / n.sum()
    return np.log((trusted + PRIOR * rate) / (n + PRIOR) / rate)


def likelihood_ratio(text: bytes | None, ratios: np.ndarray) -> float:
    found = ngram_buckets(text)
    return float(ratios[found].mean()) if len(found) else 0.0


def trusted_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """(text, good): every document, marked if it is labelled good and nowhere bad. A null id is never."""
    good = (
        labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label).alias("low")).where("low = 1").select("_id", F.lit(True).alias("_good"))
    )
    return docs.join(good.hint("merge"), docs[id_col] == good["_id"], "left")


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept.

    ``base_failed``: under 50 words, or more than half of the words in repeated windows.
    ``kept``: not so, and ``llr`` is at least ``threshold``. Null texts have no words and
    fail. Without trusted documents every ``llr`` is 0. Repeated rows get equal results;
    each of them counts in the corpus. A column that has the name of a new one is replaced.
    """
    slim = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    counts = stage(count_ngrams(trusted_rows(slim, labels, id_col), F.coalesce("_good", F.lit(False))), "ngrams")
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(counts))  # of fixed size

    def run(texts):
        found = list(zip(*[statistics(t) for t in texts])) or [()] * 5
        llr = [likelihood_ratio(t, ratios.value) for t in texts]
        return [*(pa.array(c, pa.int64()) for c in found), pa.array(llr, pa.float64())]

    fields = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, llr double"
    rows = docs.drop("base_failed", "kept") if keep is None else docs
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        text_map(rows, run, fields, text_col, keep).withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    )
