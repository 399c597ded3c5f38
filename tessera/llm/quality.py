"""Quality rules: hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Two passes over the corpus. The first counts hashed word unigrams and bigrams of all documents, and of those that the
labels call trusted (at most target_rows of them, taken by the hash of their id). The second scores every document by
the mean log ratio of the two smoothed multinomials over its n-grams and applies one fixed threshold, after plain rules
on word counts and repeated word windows. Only the two arrays of `buckets` numbers are broadcast.

Defined cases: a null or empty text has no words and is rejected; equal texts get equal verdicts; an empty table gives
an empty result; without trusted labels the ratio is 0 everywhere, so only the plain rules decide; repeated rows count as
often as they are there; a null doc_id is never trusted; a ratio at the threshold is kept; very long texts are whole.
Other columns, of any name, are ignored by quality_features and passed on by quality_filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, byte_texts, id_and_text, mix64, slices, small_batches, split_words, starts_of

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
BUCKETS = 16_384
TARGET_ROWS = 20_000
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.15
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 0.30

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ratio double, kept boolean"


def ngram_buckets(hashes: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams, then of all bigrams within a text; and the text that each belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    two = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    pairs = mix64(hashes[two] * np.uint64(3) + hashes[two + 1]) if len(two) else np.zeros(0, np.uint64)
    return (np.concatenate([hashes, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([owner, owner[two]])


def repeated_words(ids: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """For each text, its words in windows of `window` words that occur twice or more in that text. Exact: ranks of ranks of pairs."""
    n = len(ids)
    owner = np.repeat(np.arange(len(counts)), counts)
    hit = np.zeros(n + 1, np.int64)
    if n >= window:
        _, rank = np.unique(ids, return_inverse=True)
        span = 1
        while span < window:  # window is a power of two
            most = int(rank.max()) + 1 if len(rank) else 1
            _, rank = np.unique(rank[:-span].astype(np.int64) * most + rank[span:], return_inverse=True)
            span *= 2
        at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
        _, inverse, times = np.unique(rank[at].astype(np.int64) * len(counts) + owner[at], return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        np.add.at(hit, again, 1)
        np.add.at(hit, again + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
    return np.diff(covered[starts_of(counts)])


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> list[int]:
    """Ids of trusted documents, at most `rows`, by the hash of the id."""
    trusted = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return [r.doc_id for r in trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log p_target - log p_raw for each bucket, from the n-grams of all documents."""
    trusted = docs.sparkSession.sparkContext.broadcast(np.asarray(sorted(target_ids(labels, target_rows)), np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        both = np.zeros((2, buckets), np.int64)
        for batch in slices(batches):
            words, counts = split_words(byte_texts(batch.column("text")))
            at, owner = ngram_buckets(known.of(words), counts, buckets)
            both[0] += np.bincount(at, minlength=buckets)
            if len(trusted.value):
                wanted = np.isin(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), trusted.value)
                both[1] += np.bincount(at[wanted[owner]], minlength=buckets)
        some = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[0][some]), pa.array(both[1][some])], ["bucket", "raw", "target"])

    counted = id_and_text(docs).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    both = np.zeros((2, buckets))
    for r in counted.collect():  # at most one row for each bucket
        both[:, r.bucket] = r.raw, r.target
    if not both[1].sum():
        return np.zeros(buckets)
    raw = (both[0] + 1) / (both[0].sum() + buckets)
    target = (both[1] + buckets * raw) / (both[1].sum() + buckets)  # a small sample leans on the raw corpus
    return np.log(target) - np.log(raw)


def features_of(batch: pa.RecordBatch, ratios: np.ndarray, known: WordHashes, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> pa.RecordBatch:
    texts = byte_texts(batch.column(text_col))
    chars = pc.utf8_length(batch.column(text_col).cast(pa.string())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words, counts = split_words(texts, lower=False)
    hashes = known.of(words)
    repeat = repeated_words(hashes, counts, WINDOW)
    lowered, _ = split_words(texts)
    at, owner = ngram_buckets(known.of(lowered), counts, len(ratios))
    grams = np.bincount(owner, minlength=len(texts))
    ratio = np.bincount(owner, weights=ratios[at], minlength=len(texts)) / np.maximum(grams, 1)
    failed = (counts < MIN_WORDS) | (100 * repeat > int(100 * MOST_REPEATED) * counts)
    spaces = np.fromiter((len(t) - len(t.translate(None, SPACE)) for t in texts), np.int64, len(texts))
    columns = {
        "doc_id": batch.column(id_col),
        "n_words": counts,
        "word_chars": chars - spaces,
        "n_symbols": np.fromiter((len(t) - len(t.translate(None, SYMBOLS)) for t in texts), np.int64, len(texts)),
        "n_dup_lines": np.fromiter(map(duplicate_lines, texts), np.int64, len(texts)),
        "n_repeat_words": repeat.astype(np.int64),
        "base_failed": failed,
        "log_ratio": ratio,
        "kept": ~failed & (ratio >= threshold),
    }
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def quality_features(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """FEATURES for each document."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, buckets, target_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            yield features_of(batch, ratios.value, known, threshold)

    return id_and_text(docs).mapInArrow(score, FEATURES)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    small_batches(docs.sparkSession)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, buckets, target_rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            yield batch.filter(features_of(batch, ratios.value, known, threshold).column("kept"))

    return docs.mapInArrow(keep, docs.schema)
