import random
import zlib
from collections import defaultdict

import numpy as np

from tessera.llm import packing
from tessera.llm.tokens import default_path

from .samples import SCHEMA, frame, texts


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def check(slots, capacity):
    by = defaultdict(list)
    for sequence, offset, length in slots:
        by[sequence].append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.randint(1, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        slots, ranks = [], defaultdict(list)
        for length, rank, count, first, each, offset in packing.plan(histogram, capacity):
            for j in range(count):
                slots.append((first + j // each, offset + j % each * length, length))
                ranks[length].append(rank + j)
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        assert check(slots, capacity) == best_fit_decreasing(lengths, capacity)


def test_pack(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    every = texts()
    rows = packing.pack(frame(spark, every).repartition(3), capacity=64, with_ids=True).collect()
    lengths = []
    for i, text in enumerate(every):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 64))
        for r in own:
            raw = np.asarray(ids[r.start : r.start + 64], "<u4").tobytes()
            assert bytes(r.ids) == raw and r.ids_crc32 == zlib.crc32(raw) and r.length == len(raw) // 4
            lengths.append(r.length)
    assert check([(r.sequence_id, r.offset, r.length) for r in rows], 64) == best_fit_decreasing(lengths, 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
