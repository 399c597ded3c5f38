"""Benchmark decontamination with one Aho-Corasick automaton.

The words of test items and documents are normalised alike (ASCII lower case; words are runs of digits, letters and
non-ASCII characters). All windows of 8 consecutive item words go into one automaton, each between single spaces; a
document's normalised text is scanned once, and a match is mapped back to its words and to the place of these words in
the original text. The items are broadcast in blocks of at most block_bytes; of a benchmark beyond that, every block has
an automaton and a pass of its own, which adds what it finds to what the row has already, so a row stays a row.

Defined cases: a null or empty text has no words and is clean; an item of fewer words than a window is one window, one
without words none; items with equal windows are all found; an empty benchmark or corpus gives clean or no rows; rows
with equal ids, or without, each have their own result; very long texts are scanned whole; other columns are ignored by
contaminated_words and passed on by decontaminate.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_texts, id_and_text, inner, slices, small_batches

WINDOW = 8
MIN_ITEMS = 2
BLOCK_BYTES = 32 << 20
#: Other bytes than those of words become spaces, A-Z become a-z.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def item_windows(text: bytes, window: int = WINDOW) -> list[bytes]:
    words = text.translate(TABLE).split()
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def automaton_of(items: list[tuple[str, bytes]], window: int):
    """An automaton whose values are (windows' number, its count of words); and the items of each window."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in item_windows(text, window):
            owners.setdefault(w, set()).add(item)
    found = ahocorasick.Automaton()
    lists = []
    for k, (w, own) in enumerate(owners.items()):
        found.add_word(f" {w.decode('latin-1')} ", (k, w.count(b" ") + 1))
        lists.append(sorted(own))
    if lists:
        found.make_automaton()
    return found, lists


def scan(text: bytes, automaton, lists, sizes: set[int] | None = None) -> tuple[list[bytes], set[int], list[str]]:
    """The words of the text, the numbers of its hit words, and the items found; sizes gets the lengths of the windows found. One byte is one character of latin-1."""
    words = text.translate(TABLE).split()
    hit: set[int] = set()
    items: set[str] = set()
    if words and lists:
        line = f" {b' '.join(words).decode('latin-1')} "
        starts: list[int] = []
        for end, (k, n) in automaton.iter(line):
            if not starts:
                starts = (np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)).tolist()
            last = bisect_left(starts, end) - 1  # the space after the match is the start of the word after it
            hit.update(range(last - n + 1, last + 1))
            items.update(lists[k])
            if sizes is not None:
                sizes.add(n)
    return words, hit, sorted(items)


def original_spans(text: bytes, hit: set[int]) -> list[tuple[int, int]]:
    """Byte offsets of each hit word in the text as it was."""
    at = np.frombuffer(text.translate(TABLE), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[0], at.view(np.int8), [0]])))
    return [(int(edges[2 * k]), int(edges[2 * k + 1])) for k in sorted(hit)]


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about block_bytes of text; they pass through the driver one block at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").toLocalIterator():
        block.append((r.item_id, r.text.encode()))
        size += len(block[-1][1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


FOUND = "doc_id long, n_words long, hit_words array<int>, items array<string>, spans array<struct<start:long,end:long>>"


def passes(start: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, text: str, add, last, schema) -> DataFrame:
    """A pass over `start` for each block of items: add(batch, automaton, items of its windows) gives the batch for the next pass, and `last` that of the result.

    A task holds one automaton at a time. A block leaves the driver before the next but one is read.
    """

    def scanner(sent, work):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, lists = held(name, sent, window) if sent is not None else (None, [])
            for batch in slices(batches, text):
                yield work(batch, automaton, lists)

        return run

    out, sent = start, None
    for block in item_blocks(benchmark, block_bytes):
        if sent is not None:
            out = out.mapInArrow(scanner(sent, add), out.schema)
        sent = out.sparkSession.sparkContext.broadcast(block)
    return out.mapInArrow(scanner(sent, last), schema)


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """FOUND: for each document the numbers of its hit words, the items found and their byte spans in the original."""
    start = id_and_text(docs).select("doc_id", "text", F.expr("cast(array() as array<int>)").alias("hit_words"), F.expr("cast(array() as array<string>)").alias("items"))

    def found(batch: pa.RecordBatch, automaton, lists) -> Iterator[tuple[bytes, int, list[int], list[str]]]:
        for text, had, own in zip(byte_texts(batch.column("text")), batch.column("hit_words").to_pylist(), batch.column("items").to_pylist(), strict=True):
            words, hit, items = scan(text, automaton, lists)
            yield text, len(words), sorted(hit.union(had)), sorted({*items, *own}) if own else items

    def add(batch: pa.RecordBatch, automaton, lists) -> pa.RecordBatch:
        _, _, hits, items = zip(*found(batch, automaton, lists), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "hit_words", "items"])

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def last(batch: pa.RecordBatch, automaton, lists) -> pa.RecordBatch:
        rows = zip(batch.column("doc_id").to_pylist(), found(batch, automaton, lists), strict=True)
        return pa.RecordBatch.from_pylist([{"doc_id": doc, "n_words": n, "hit_words": hit, "items": items, "spans": [{"start": a, "end": b} for a, b in original_spans(text, set(hit))] if hit else []} for doc, (text, n, hit, items) in rows], schema)

    return passes(start, benchmark, window, block_bytes, "text", add, last, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, whole_window: bool = False) -> DataFrame:
    """The rows of docs in which fewer than min_items items occur, with all their columns.

    whole_window: one item is enough if a window of the full length occurs; items of fewer words still need min_items.
    """
    small_batches(docs.sparkSession)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # names of docs can't meet those used here
    start = docs.select(own.alias("own"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(False).alias("long"))

    def found(batch: pa.RecordBatch, automaton, lists) -> tuple[list[list[str]], list[bool]]:
        items, long = [], []
        for text, had, was in zip(byte_texts(inner(batch, "own.text")), batch.column("items").to_pylist(), batch.column("long").to_pylist(), strict=True):
            sizes: set[int] = set()
            items.append(sorted({*scan(text, automaton, lists, sizes)[2], *had}))
            long.append(was or window in sizes)
        return items, long

    def add(batch: pa.RecordBatch, automaton, lists) -> pa.RecordBatch:
        items, long = found(batch, automaton, lists)
        return pa.RecordBatch.from_arrays([batch.column("own"), pa.array(items, pa.list_(pa.string())), pa.array(long)], ["own", "items", "long"])

    def last(batch: pa.RecordBatch, automaton, lists) -> pa.RecordBatch:
        items, long = found(batch, automaton, lists)
        clean = [len(own) < min_items and not (whole_window and one) for own, one in zip(items, long, strict=True)]
        return pa.RecordBatch.from_struct_array(batch.column("own").filter(pa.array(clean, pa.bool_())))

    return passes(start, benchmark, window, block_bytes, "own.text", add, last, docs.schema)


_held: dict = {}


def held(name: str, block, window: int):
    """The automaton of the block that this worker process looked for last; name is that of the pass."""
    if name not in _held:
        _held.clear()
        _held[name] = automaton_of(block.value, window)
    return _held[name]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
