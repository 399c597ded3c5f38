import random
import zlib

import pytest

from tessera.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard int"


def shards_of(texts_by_place, capacity):
    n, load = 1, 0
    for size in texts_by_place:
        if size > capacity:
            return 10**9
        if load + size > capacity:
            n, load = n + 1, 0
        load += size
    return n


def brute(rows, shards):
    groups = {}
    for r in rows:
        groups[r.place] = groups.get(r.place, 0) + r.size
    order = [groups[p] for p in sorted(groups)]
    low, high = 1, sum(order)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if shards_of(order, middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("bits", [(16, 8), (1, 1), (3, 2)])
@pytest.mark.parametrize("hot", [0, 150])
def test_smallest_capacity_as_brute_force(spark, bits, hot):
    rng = random.Random(bits[0] * 1000 + hot)
    texts = ["x" * rng.randint(0, 400) + str(rng.randint(0, 150)) for _ in range(300)] + ["the same text " * 9] * hot + [None, "", ""]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], SCHEMA)
    rows = sharding.sizes(docs).cache()
    cuts = sharding.minimax_cuts(rows, 7, *bits)
    loads = [0] * 7
    for r in rows.collect():
        loads[sum(r.place > c for c in cuts)] += r.size
    assert max(loads) == brute(rows.collect(), 7)


def test_shards_and_slots(spark):
    texts = [f"document {i % 40} " * (i % 7 + 1) for i in range(200)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], SCHEMA)
    out = sharding.shard_by_bytes(docs, 5).collect()
    assert len(out) == len(texts)
    where = {}
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        assert r.size == len(b) + 8 and r.text_crc32 == zlib.crc32(b)
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_empty_table(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
