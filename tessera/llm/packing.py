"""Best-fit packing planned on the histogram of lengths.

Texts become token ids with an end id; only a text of more than `capacity` ids is cut, into pieces of that length and a
last shorter one. Best-fit decreasing then runs over the counts of the lengths, not over documents: sequences of equal
room are one range of sequence ids, and one step fills as many of them as the count of a length allows. The plan is a
list of runs (length, first rank, count, first sequence, pieces in a sequence, first offset); its size depends on the
number of lengths, not of documents. A piece takes its slot by its rank among the pieces of its length: the rank within
its task plus the counts of earlier tasks.

Defined cases: a null or empty text is its end id alone; equal texts are packed each for itself; an empty table gives an
empty result; a null doc_id stays null; only a text beyond the capacity is cut, however long it is. Other columns, of any
name, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_texts, id_and_text, slices, write_table
from .tokens import held

CAPACITY = 4096
END_ID = 1

#: length, first rank, count, first sequence, pieces of this length in each sequence, offset of the first
Run = tuple[int, int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts, exactly as over single pieces: a piece goes where the least room is left that holds it."""
    runs: list[Run] = []
    rooms: list[int] = []  # in ascending order
    of: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sequences
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in of:
                of[room] = []
                insort(rooms, room)
            of[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = of[room].pop()
                if not of[room]:
                    del of[room], rooms[k]
            else:
                room = capacity
                first, n = sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer pieces are left than one sequence has room for
                runs.append((length, rank, left, first + full, left, capacity - room))
                leave(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(room, first + full, n - full)
    return runs


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids), chunk and rank: the place among the task's pieces of equal length."""
    schema = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int32()), ("rank", pa.int64())]
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, rank long"
    if with_ids:
        schema, ddl = [*schema, ("ids", pa.binary())], f"{ddl}, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            ids, counts = held(tokenizer).encode(byte_texts(batch.column("text")))
            n = -(-(counts + 1) // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[doc] + 1 - start, capacity)
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
            seen += np.bincount(length, minlength=capacity + 1)
            first = np.concatenate([[0], np.cumsum(counts)])
            own = []
            for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                part = ids[first[d] + s : min(first[d] + s + m, first[d + 1])].astype("<u4").tobytes()
                own.append(part if len(part) == 4 * m else part + int(end_id).to_bytes(4, "little"))
            columns = [batch.column("doc_id").take(pa.array(doc)), piece.astype(np.int32), start, length, [zlib.crc32(x) for x in own], np.full(len(doc), chunk, np.int32), rank]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, (_, t) in zip([*columns, own] if with_ids else columns, schema, strict=True)], [k for k, _ in schema])

    return id_and_text(docs).mapInArrow(cut, ddl)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset for each piece."""
    table = write_table(pieces(docs, capacity, end_id, tokenizer, with_ids), "pieces")
    counts = table.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = np.asarray(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    sent = docs.sparkSession.sparkContext.broadcast((runs[:, 0] * 2**44 + runs[:, 1], runs))
    before = counts.select("chunk", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = table.join(before, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("chunk", "before")
    kept = [c for c in ["doc_id", "piece", "start", "length", "ids_crc32", "ids"] if c in ranked.columns]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * 2**44 + rank, side="right") - 1]
            j = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(run[:, 3] + j // run[:, 4]), pa.array(run[:, 5] + j % run[:, 4] * length)], [*kept, "sequence_id", "offset"])

    types = dict(ranked.dtypes)
    return ranked.mapInArrow(take, ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long")
