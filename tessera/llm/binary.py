"""Token-id files: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart from data bytes.

An id is stored as its rank by frequency (0 is the most frequent), little-endian in 1 to 4 bytes. Four ids share one
control byte with two bits each, their length less one. A shard file holds blocks of documents in ascending doc_id order:

    magic, then for each block: four uint64 (documents, ids, control bytes, data bytes), doc ids int64, 1 for each
    doc id that is not null, ids in each document int64, control bytes, data bytes

Reading looks lengths and offsets of four ids up in tables of 256 rows, for a whole block at a time. `ranks` in the same
folder has the id of each rank as uint32. Every writing task puts its shard under a name of its own, and the manifest
names the shards of the attempts that Spark counted, so lost executors and repeated tasks leave no wrong file in use.

Defined cases: a null or empty text is its end id alone; a null doc_id comes first; equal ids follow each other; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_texts, drop_tables, id_and_text, new_path, slices, write_table
from .tokens import held

END_ID = 2
BLOCK_IDS = 1 << 20
MAGIC = b"TESSERA1"
HEAD = struct.Struct("<4Q")

_codes = np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3
#: For each control byte: bytes of each of its four ids, where each begins, and all bytes.
LENGTH = (_codes + 1).astype(np.int64)
OFFSET = np.cumsum(LENGTH, axis=1) - LENGTH
TOTAL = LENGTH.sum(axis=1)
MASK = np.asarray([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes. The last control byte may stand for fewer than four ids; it codes the rest as length 1."""
    r = ranks.astype("<u4")
    code = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = code
    control = (four.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks."""
    c = np.frombuffer(control, np.uint8)
    total = TOTAL[c]
    at = ((np.cumsum(total) - total)[:, None] + OFFSET[c]).ravel()[:n]
    raw = np.frombuffer(data + bytes(4), np.uint8)
    wide = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        wide |= raw[np.minimum(at + k, len(raw) - 1)].astype(np.uint32) << np.uint32(8 * k)
    return wide & MASK[LENGTH[c].ravel()[:n]]


def block_bytes(docs: list[int | None], sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode(ranks)
    ids = np.asarray([x or 0 for x in docs], "<i8").tobytes()
    return HEAD.pack(len(docs), len(ranks), len(control), len(data)) + ids + bytes(x is not None for x in docs) + sizes.astype("<i8").tobytes() + control + data


def read_blocks(f) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, ids in each document, and ranks, block by block."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    while head := f.read(HEAD.size):
        n, ids, control, data = HEAD.unpack(head)
        docs = np.frombuffer(f.read(8 * n), "<i8").tolist()
        there = f.read(n)
        sizes = np.frombuffer(f.read(8 * n), "<i8")
        yield [d if v else None for d, v in zip(docs, there, strict=True)], sizes, decode(f.read(control), f.read(data), ids)


def open_fs(path: str):
    """The file system of a path that all machines reach, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def tokens_of(docs: DataFrame, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids: little-endian unsigned integers of 4 bytes, or of 2 where the vocabulary allows, with the end id."""
    width = id_width(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([end_id], width).tobytes()
        for batch in slices(batches):
            ids, counts = held(tokenizer).encode(byte_texts(batch.column("text")))
            raw, size = memoryview(ids.astype(width).tobytes()), np.dtype(width).itemsize
            ends = np.cumsum(counts) * size
            own = [bytes(raw[b - n * size : b]) + end for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary())], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary")


def id_width(tokenizer: str | None, end_id: int) -> str:
    return "<u2" if max(len(held(tokenizer).ends), end_id + 1) <= 1 << 16 else "<u4"


def frequencies(tokens: DataFrame, width: str, ids: int) -> np.ndarray:
    """How often each id occurs; at most one row for each id of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ids, np.int64)
        for batch in slices(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(byte_texts(batch.column("ids"))), width), minlength=ids)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(ids, np.int64)
    for r in tokens.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write_files(docs: DataFrame, folder: str | None = None, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Writes the files and returns the manifest: shard, path, docs, tokens. folder must be reachable from all machines."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    width, vocabulary = id_width(tokenizer, end_id), max(len(held(tokenizer).ends), end_id + 1)
    tokens = write_table(tokens_of(docs, end_id, tokenizer), "tokens")
    often = frequencies(tokens, width, vocabulary)
    by_rank = np.lexsort((np.arange(vocabulary), -often)).astype("<u4")
    rank = np.empty(vocabulary, np.uint32)
    rank[by_rank] = np.arange(vocabulary)
    fs, place = open_fs(folder)
    fs.create_dir(place)
    with fs.open_output_stream(f"{place}/ranks") as f:
        f.write(by_rank.tobytes())
    sent = spark.sparkContext.broadcast(rank)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, place = open_fs(folder)
        shard, name = TaskContext.get().partitionId(), None
        n_docs = n_tokens = 0
        f = None
        held_docs: list[int | None] = []
        held_ids: list[np.ndarray] = []

        def flush() -> None:
            sizes = np.fromiter(map(len, held_ids), np.int64, len(held_ids))
            f.write(block_bytes(held_docs, sizes, sent.value[np.concatenate(held_ids)]))
            held_docs.clear()
            held_ids.clear()

        waiting = 0
        for batch in slices(batches, "ids"):
            if f is None:
                name = f"{place}/shard-{shard:06d}-{uuid.uuid4().hex}"
                f = fs.open_output_stream(name)
                f.write(MAGIC)
            for doc, raw in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("ids")), strict=True):
                held_docs.append(doc)
                held_ids.append(np.frombuffer(raw, width))
                waiting += len(held_ids[-1])
                n_docs, n_tokens = n_docs + 1, n_tokens + len(held_ids[-1])
                if waiting >= BLOCK_IDS:
                    flush()
                    waiting = 0
        if f is not None:
            if held_docs:
                flush()
            f.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name.rsplit("/", 1)[1]], "docs": [n_docs], "tokens": [n_tokens]})

    files = write_table(tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(write, "shard int, path string, docs long, tokens long"), "manifest")
    drop_tables(tokens)
    return files.withColumn("path", F.concat(F.lit(f"{folder}/"), "path"))


def read_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (, ids array) from the files of the manifest."""
    shards = sorted(manifest.collect(), key=lambda r: r.shard)  # a row for each file
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    start, todo = 0, []
    for r in shards:
        todo.append((r.path, start))
        start += r.tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, place = open_fs(path)
                with fs.open_input_stream(f"{place.rsplit('/', 1)[0]}/ranks") as f:
                    by_rank = np.frombuffer(f.read(), "<u4")
                with fs.open_input_stream(place) as f:
                    for docs, sizes, ranks in read_blocks(f):
                        ids = by_rank[ranks]
                        ends = np.cumsum(sizes)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                        columns = [pa.array(docs, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                        start += int(ends[-1])

    files = spark.createDataFrame(todo, "path string, start long").repartition(len(todo))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
