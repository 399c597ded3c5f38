import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm

from .samples import SCHEMA, frame, texts

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_model(seed=1):
    tokens = [(int(h), n) for h, n in zip(np.random.default_rng(seed).integers(1, 2**62, 50), range(100, 50, -1), strict=True)]
    tokens[3] = (int(lm.END.view(np.int64)), 97)
    v = lm.Vocabulary(tokens, 5000, 300, 80)
    m = lm.Network.initial(v, hidden=5)
    return v, lm.Network({k: a.astype(np.float64) for k, a in m.p.items()})


def test_gradients_as_differences(monkeypatch):
    v, m = small_model()
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 51, (6, 4)), rng.integers(0, 51, (6, 4))
    fresh, real = rng.random((6, 4)) < 0.2, rng.random((6, 4)) < 0.9
    h = rng.normal(0, 0.5, (4, 5))
    n = int(real.sum())
    grads, _, _ = m.gradients(x, y, fresh, real, h)
    rows, own = grads["table"]
    table = np.zeros_like(m.p["table"])
    table[rows] = own
    grads["table"] = table
    for k in lm.Network.NAMES:
        flat = m.p[k].reshape(-1)
        for i in rng.integers(0, flat.size, 25):
            keep, step = flat[i], 1e-3
            losses = []
            for d in (step, -step):
                flat[i] = keep + d
                losses.append(-m.gradients(x, y, fresh, real, h)[2] / n)
            flat[i] = keep
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(grads[k].reshape(-1)[i], abs=2e-4)


def test_probabilities_sum_to_one():
    v, m = small_model()
    h = np.random.default_rng(3).normal(0, 1, (7, 5))
    total = sum(np.exp(m.outputs(h, np.full(7, r))) for r in range(51))
    assert total == pytest.approx(np.ones(7), abs=1e-5)
    tail = [5] * 10 + [1] * 5
    v = lm.Vocabulary([(1, 40)], 40 + sum(tail), 16, 5)
    assert sum(10 ** v.tail_log10(np.asarray(tail, float))) + 10 ** v.tail_log10(np.zeros(1))[0] == pytest.approx(1)


def test_streams_hold_every_token_once():
    rng = random.Random(1)
    counts = np.asarray([rng.randint(1, 40) for _ in range(70)])
    grid, fresh = lm.streams_of(counts, 8)
    assert sorted(grid[grid >= 0].tolist()) == list(range(counts.sum()))
    starts = set((np.cumsum(counts) - counts).tolist())
    assert set(grid[fresh].tolist()) == starts
    for column in grid.T:
        for a, b in zip(column, column[1:], strict=False):
            assert b == -1 or b in starts or b == a + 1


def corpus(rng):
    """Texts in two made-up languages, so that context helps."""
    kinds = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    return [" ".join(rng.choice(rng.choice([kinds[k][:5], kinds[k]])) for _ in range(rng.randint(20, 80))) for k in [rng.randint(0, 1) for _ in range(600)]]


def test_scores(spark):
    every = corpus(random.Random(2)) + texts()
    counts, words = Counter(), []
    for i, t in enumerate(every):
        words.append(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)) + [None])
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(words[-1])
    n, types = sum(counts.values()), len(counts)
    rows = sorted(lm.scores(frame(spark, every), chunk_bytes=20_000, rounds=(0.3, 0.7)).collect(), key=lambda r: r.doc_id)
    for r, w in zip(rows, words, strict=True):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (types + 1))) for x in w))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 1.01 * sum(r.base_score for r in held)
    same = {}
    for r, t in zip(rows, every, strict=True):
        assert same.setdefault(t or "", r.score) == pytest.approx(r.score, rel=1e-4)


def test_training_beats_unigrams_on_held_out_texts():
    every = [t.encode() for t in corpus(random.Random(4))]
    h, counts = lm.token_hashes(every, lm.WordHashes())
    types, n = np.unique(h, return_counts=True)
    v = lm.Vocabulary([(int(t.view(np.int64)), int(c)) for t, c in sorted(zip(types, n, strict=True), key=lambda x: -x[1])], int(n.sum()), len(n), 0)
    m = lm.Network.initial(v)
    adam = lm.Adam(m.p, 0.01)
    cut = int(counts[:500].sum())
    for _ in range(4):
        state = np.zeros((32, lm.HIDDEN), np.float32)
        for inputs, targets, fresh, real, _ in lm.windows(v.ranks(h[:cut]), counts[:500], v.end, 32, 16, even=True):
            grads, state, _ = m.gradients(inputs, targets, fresh, real, state)
            adam.update(grads)
    ranks, total = v.ranks(h[cut:]), 0.0
    for inputs, targets, fresh, real, _ in lm.windows(ranks, counts[500:], v.end, 64, 16):
        state = np.zeros((inputs.shape[1], lm.HIDDEN), np.float32)
        states, _, _ = m.run(inputs, fresh, state)
        total += m.outputs(states[real], targets[real]).sum()
    assert total > 0.95 * np.log(v.counts[ranks] / v.total).sum()


def test_no_rows_and_no_training_rows(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = lm.scores(frame(spark, ["some words"], only)).collect()[0]
    assert got.held_out and got.train_tokens == 0 and got.n_known == 0 and math.isfinite(got.score)


def test_scores_do_not_depend_on_partitions(spark):
    docs = frame(spark, corpus(random.Random(5))[:200] + texts(n=12))
    one, eight = ({r.doc_id: r for r in lm.scores(docs.repartition(n), chunk_bytes=20_000).collect()} for n in (1, 8))
    for i, r in one.items():
        assert r.score == pytest.approx(eight[i].score, rel=1e-6) and r.base_score == pytest.approx(eight[i].base_score)


def plain_score(model, v, words, counts):
    """log10 probability of one text, word by word."""
    p = {k: a.astype(np.float64) for k, a in model.p.items()}
    size, tail = p["ww"].shape[2], len(v.hashes)
    h, last, total = np.zeros(len(p["gates"])), v.end, 0.0
    for w, c in zip(words, counts, strict=True):
        n, g, u = len(h), p["table"][last], h @ p["gates"]
        z, r = (1 / (1 + np.exp(-(g[k * n : k * n + n] + u[k * n : k * n + n]))) for k in (0, 1))
        h = (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :]) + z * h
        a = h @ p["wc"] + p["bc"]
        a -= math.log(np.exp(a).sum())
        last = int(v.ranks(np.asarray([w]))[0])
        if last == tail:
            total += a[-1] / math.log(10) + v.tail_log10(np.asarray([c]))[0]
        else:
            b = h @ p["ww"][last // size] + p["bw"][last // size]
            total += (a[last // size] + b[last % size] - math.log(np.exp(b).sum())) / math.log(10)
    return total


def test_score_as_plain_sum_at_every_length():
    every = [t.encode() for t in corpus(random.Random(4))[:60]] + [b"", b"a1", b"a1 b2 " * 3000, b"never met " * 40]
    h, counts = lm.token_hashes(every, lm.WordHashes())
    types, which, n = np.unique(h, return_inverse=True, return_counts=True)
    seen = np.where(n > 3, n, 0)
    v = lm.Vocabulary([(int(t.view(np.int64)), int(c)) for t, c in sorted(zip(types, seen, strict=True), key=lambda x: -x[1])[:40]], int(seen.sum()), int((seen > 0).sum()), 2)
    m = lm.Network.initial(v, seed=3)
    c = seen[which]
    rank = v.ranks(h).astype(np.int32)
    first = np.cumsum(counts) - counts
    tail = np.add.reduceat(np.where(rank == len(v.hashes), v.tail_log10(c), 0.0), first)
    out = lm.scored([(list(range(len(every))), counts, counts, tail, tail, rank)], m, v).column("score").to_pylist()
    for i, (a, k) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
        assert out[i] == pytest.approx(plain_score(m, v, h[a : a + k], c[a : a + k]), rel=1e-4), i


def test_a_text_of_a_million_words(spark):
    long = "one two three four five six seven eight nine ten " * 100_000
    got = {r.doc_id: r for r in lm.scores(frame(spark, [long, "one two", None]), chunk_bytes=1 << 20).collect()}
    assert got[0].n_tokens == 1_000_001 and math.isfinite(got[0].score) and got[2].n_tokens == 1


def test_pieces_of_a_long_text_are_its_tokens():
    import pyarrow as pa

    every, known = [b"some words here " * 50, b"", b"x" * 90, b"a b  c\n" * 30], lm.WordHashes()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None, 4]), pa.array([t.decode() for t in every])], ["doc_id", "text"])
    whole, cut = lm.Chunk(), lm.Chunk()
    whole.add(batch, known)
    keep, lm.long_pieces.__defaults__ = lm.long_pieces.__defaults__, (64,)
    try:
        cut.add(batch, known)
    finally:
        lm.long_pieces.__defaults__ = keep
    for a, b in zip(whole.done(), cut.done(), strict=True):
        assert a.tolist() == b.tolist()
    assert whole.docs == cut.docs == [1, 2, None, 4]


def test_kept_tokens_grow():
    assert [lm.kept_tokens(n) for n in (0, 10**8, 10**9, 10**12)] == sorted({lm.kept_tokens(n) for n in (0, 10**8, 10**9, 10**12)})


def test_outputs_fill_one_array_of_all_classes():
    import tracemalloc

    v = lm.Vocabulary([(i, 5000 - i) for i in range(4096)], 20_000_000, 9000, 100)
    net, rng = lm.Network.initial(v, 16), np.random.default_rng(4)
    h, rank = rng.uniform(-1, 1, (8192, 16)).astype(np.float32), np.full(8192, 4096)
    net.outputs(h[:8], rank[:8])
    tracemalloc.start()
    log = net.outputs(h, rank)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a = h.astype(np.float64) @ net.p["wc"].astype(np.float64) + net.p["bc"]
    want = a[:, -1] - np.log(np.exp(a).sum(axis=1))
    assert np.abs(log - want).max() < 1e-5
    assert peak < 1.5 * 4 * a.size  # passes over further arrays of that size take much of the time
