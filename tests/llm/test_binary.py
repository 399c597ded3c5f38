import zlib

import numpy as np

from tessera.llm import binary
from tessera.llm.tokens import default_path

from .samples import SCHEMA, frame, texts


def test_round_trip_of_all_lengths():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = np.concatenate([rng.integers(0, 2**b, n, np.uint64) for b in (4, 8, 9, 16, 17, 24, 25, 32)]).astype(np.uint32)
        rng.shuffle(ranks)
        assert (binary.decode(*binary.encode(ranks), len(ranks)) == ranks).all()
    edges = np.asarray([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    assert (binary.decode(*binary.encode(edges), len(edges)) == edges).all()


def test_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    every = texts()
    manifest = binary.write_files(frame(spark, every).repartition(3))
    rows = sorted(binary.read_files(spark, manifest).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, text in zip(rows, every, strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert list(r.ids) == ids and (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        at += len(ids)
    assert sum(r.tokens for r in manifest.collect()) == at


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (-1, None)], "doc_id long, text string")
    rows = sorted(binary.read_files(spark, binary.write_files(docs)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -1, 3, 3]


def test_empty_table(spark):
    assert binary.read_files(spark, binary.write_files(spark.createDataFrame([], SCHEMA))).count() == 0
