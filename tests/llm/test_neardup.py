import random
import re

import pytest

from tessera.llm import neardup

from .samples import SCHEMA, frame, texts, words
from .test_graph import brute as components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(every, width, percent):
    sets = [shingles(t, width) for t in every]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    group = components(links)
    return [(len(s), group.get(i, i)) for i, s in enumerate(sets)]


def variants(rng, n):
    """Chains and stars of texts that differ a little, on both sides of the threshold."""
    base = words(rng, 200)
    out = []
    for _ in range(n):
        w = list(rng.choice(out)) if out and rng.random() < 0.5 else list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 9999)}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_as_brute_force(spark, width, percent):
    every = texts(n=40) + variants(random.Random(width), 90) + ["A b C", "a B c", "a b", "A B"]
    got = sorted(neardup.near_duplicates(frame(spark, every).repartition(3), width, percent).collect(), key=lambda r: r.doc_id)
    assert [(r.n_shingles, r.component_id) for r in got] == brute(every, width, percent)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    every = variants(random.Random(9), 60)
    got = sorted(neardup.near_duplicates(frame(spark, every), 3, 85).collect(), key=lambda r: r.doc_id)
    assert [(r.n_shingles, r.component_id) for r in got] == brute(every, 3, 85)


def test_kept_rows_and_columns(spark):
    docs = frame(spark, ["same text of some words here"] * 3 + [None, "", "other"])
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    twice = docs.union(docs.where("doc_id = 0"))
    assert neardup.near_duplicates(twice).where("doc_id = 0 and kept").count() == 2


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
