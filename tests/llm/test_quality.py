import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import quality

from .samples import SCHEMA, frame, texts


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at, hit, seen, lines = defaultdict(list), set(), set(), 0
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    for own in at.values():
        if len(own) > 1:
            hit.update(x for k in own for x in range(k, k + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, buckets):
    """Buckets of the words and pairs of words of one text, with plain integers."""
    most = 2**64 - 1
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))]
    out = [x % buckets for x in h]
    for a, b in zip(h, h[1:], strict=False):
        x = (a * 3 + b) & most
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & most
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & most
        out.append((x ^ x >> 31) % buckets)
    return out


def brute_ratios(every, trusted, buckets=quality.BUCKETS):
    """Mean log ratio of each text; trusted: numbers of the target texts."""
    each = [grams(t, buckets) for t in every]
    raw, target = Counter(x for g in each for x in g), Counter(x for i in trusted for x in each[i])
    n, m = sum(raw.values()), sum(target.values())
    p = {x: (c + 1) / (n + buckets) for x, c in raw.items()}
    ratio = {x: math.log((target[x] + buckets * p[x]) / (m + buckets)) - math.log(p[x]) for x in raw} if m else {}
    return [sum(ratio.get(x, 0.0) for x in g) / max(1, len(g)) for g in each]


def test_ratio_and_verdict_as_brute_force(spark):
    every = [*texts(), "AN Upper Case text", "é ü 日本 " * 9]
    trusted = list(range(0, len(every), 3))
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(1, 1, 1), (2, 0, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, every)
    for threshold in (quality.THRESHOLD, 0.01):
        got = sorted(quality.quality_features(docs.repartition(3), labels, threshold).collect(), key=lambda r: r.doc_id)
        for r, want, text in zip(got, brute_ratios(every, trusted), every, strict=True):
            assert r.log_ratio == pytest.approx(want, abs=1e-9) and r.kept == (not brute(text)[5] and want >= threshold)


def test_base_as_brute_force(spark):
    every = [*texts(), "a b c d e f g h " * 3, "#*$%&|<> " * 30, "\x1cx\x85y z\xa0" * 9]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, len(every), 3)], "doc_id long, quality int, toxic int")
    got = sorted(quality.quality_features(frame(spark, every), labels).collect(), key=lambda r: r.doc_id)
    for r, text in zip(got, every, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
        assert r.kept == (not r.base_failed and r.log_ratio >= quality.THRESHOLD)
    kept = quality.quality_filter(frame(spark, every), labels)
    assert kept.columns == frame(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_ratio_tells_junk_from_prose(spark):
    prose = [" ".join(f"good{(i * j) % 50}" for j in range(1, 60)) for i in range(40)]
    junk = [" ".join(f"bad{(i * j) % 50}%%%" for j in range(1, 60)) for i in range(40)]
    docs = frame(spark, prose + junk)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.log_ratio for r in quality.quality_features(docs, labels).collect()}
    assert min(got[i] for i in range(40)) > 0 > max(got[i] for i in range(40, 80))


def test_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_features(spark.createDataFrame([], SCHEMA), none).count() == 0
    assert (quality.log_ratios(frame(spark, texts()), none) == np.zeros(quality.BUCKETS)).all()
