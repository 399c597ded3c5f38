import hashlib
import pathlib
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import shared, suffix

from .samples import SCHEMA, frame, texts


def brute(every):
    first = {}
    raw = [(t or "").encode() for t in every]
    for d, b in enumerate(raw):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


def hard(rng):
    block = ["".join(rng.choice("ab \0é") for _ in range(rng.choice([30, 49, 50, 51, 70]))) for _ in range(6)]
    return ["".join(rng.choice(block) for _ in range(rng.randint(0, 5))) for _ in range(60)] + ["a" * n for n in (48, 49, 50, 51, 120, 49)] + ["\0" * 60, "\0" * 50, "é" * 25 + "x", "é" * 25]


def test_as_brute_force(spark):
    every = [*texts(n=24), *hard(random.Random(4))]
    want = brute(every)
    got = sorted(suffix.digests(frame(spark, every).repartition(3)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [(*w[:3], hashlib.sha256(w[3]).hexdigest()) for w in want]
    assert {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(frame(spark, every)).collect()} == {i: w[3] for i, w in enumerate(want)}


def test_repeated_rows_and_no_rows(spark):
    docs = frame(spark, ["some text " * 9, "some text " * 9])
    got = suffix.digests(docs.union(docs)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (0, 0), (1, 90), (1, 90)]
    assert suffix.digests(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("ab\0", max_size=suffix.MATCH), max_size=12), max_size=7))
def test_loser_tree_sorts_and_knows_prefixes(lists):
    strings = [sorted((s.encode() for s in own), key=lambda s: s.ljust(suffix.MATCH, b"\0")) for own in lists]
    shared = [suffix.front_coded(s)[0].tolist() if s else [] for s in strings]
    order, lengths = suffix.merge(strings, shared)
    out = [strings[r][i].ljust(suffix.MATCH, b"\0") for r, i in order]
    assert out == sorted(s.ljust(suffix.MATCH, b"\0") for own in strings for s in own)
    assert [i for r, i in order if r == 0] == list(range(len(strings[0]) if strings else 0))
    for a, b, n in zip(out, out[1:], lengths[1:], strict=False):
        assert n == next((k for k in range(suffix.MATCH) if a[k] != b[k]), suffix.MATCH)


def test_each_match_has_an_anchor_chosen_by_its_bytes():
    rng = random.Random(2)
    every = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    owner, place, h = suffix.anchors(every)
    of = {}
    for o, p, x in zip(owner.tolist(), place.tolist(), h.tolist(), strict=True):
        of.setdefault(o, {})[p] = x
        assert p + suffix.SEED <= len(every[o])
    seen = {}
    for i, text in enumerate(every):
        for s in range(len(text) - 49):
            inside = [(p - s, x) for p, x in of.get(i, {}).items() if s <= p <= s + suffix.LEFT]
            least = min(x for _, x in inside)
            chosen = min(k for k, x in inside if x == least)
            assert seen.setdefault(text[s : s + 50], chosen) == chosen
    assert np.diff(owner).min() >= 0


def test_long_texts_in_segments(monkeypatch):
    rng = random.Random(5)
    text = bytes(rng.choice(b"ab") for _ in range(9000))
    whole = suffix.anchors_of([text, b"x" * 60, b""])
    monkeypatch.setattr(suffix, "SLICE", 700)
    for a, b in zip(suffix.anchors([text, b"x" * 60, b""]), whole, strict=True):
        assert (a == b).all()


def test_a_passage_in_most_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix, "RUN_ROWS", 50)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    every = [f"{rng.random()} {passage if i % 3 else passage[40:200]} {rng.random()}" for i in range(80)]
    want = brute(every)
    got = sorted(suffix.digests(frame(spark, every).repartition(5)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [(*w[:3], hashlib.sha256(w[3]).hexdigest()) for w in want]


def test_runs_are_read_as_written():
    rng = random.Random(7)
    every = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 130))) for _ in range(30)]
    owner, place, _ = suffix.anchors(every)
    rows = suffix.Suffixes.of(every, owner, place, np.arange(30))
    rows = rows.take(np.argsort([bytes(r) for r in rows.right], kind="stable"))
    back, shared = suffix.Suffixes.load(rows.dump())
    assert all((getattr(back, k) == getattr(rows, k)).all() for k in rows.NAMES) and len(shared) == len(rows) > 0
    for r, p, d in zip(rows.right, rows.place.tolist(), rows.doc.tolist(), strict=True):
        assert bytes(r) == every[d][p : p + suffix.MATCH].ljust(suffix.MATCH, b"\0")


def test_runs_are_compressed_and_whole():
    rng = random.Random(6)
    every = [" ".join(rng.choice(["some", "ordinary", "words", "of", "prose", "that", "texts", "repeat"]) + str(rng.randint(0, 300)) for _ in range(400)).encode() for _ in range(20)]
    owner, place, _ = suffix.anchors(every)
    rows = suffix.Suffixes.of(every, owner, place, np.arange(20) * 10**11 - 5)
    rows = rows.take(np.lexsort(rows.right.T[::-1]))
    blob = rows.dump()
    assert len(blob) < 60 * len(rows)  # 84 bytes around the anchor, id and place
    back, lengths = suffix.Suffixes.load(blob)
    assert all((getattr(back, k) == getattr(rows, k)).all() for k in suffix.Suffixes.NAMES) and list(lengths) == suffix.shared_lengths(rows.right).tolist()
    assert len(suffix.Suffixes.load(rows.take(slice(0, 0)).dump())[0]) == 0


def test_shuffle_files_go_with_their_step(spark):
    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name for d in dirs for f in pathlib.Path(d.getPath()).rglob("shuffle_*")}

    before, kept = files(), spark.conf.get(shared.CLEANUP, None)
    table = shared.write_table(spark.range(1000).repartition(3, "id"), "test", free=True)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and table.count() == 1000 and spark.conf.get(shared.CLEANUP, None) == kept
