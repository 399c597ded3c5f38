"""Suffix-array removal of repeated byte strings, by a common-prefix-aware distributed merge sort.

A byte goes if a string of MATCH bytes that covers it also starts in a document with a smaller doc_id. Sorting every
suffix would move many times the corpus, so two steps that lose nothing come first. Equal texts form a class, and only
its first document is looked into. And suffixes start at anchors only: of the SEED-byte strings in each MATCH-byte
string, the one with the least hash. The choice depends on these bytes alone, so equal strings have equal anchors, at a
density of about one in 18 bytes. Anchors found in one text only are dropped (an exchange of their hashes tells).

Each task then sorts its suffixes and sends runs, front-coded: the length shared with the suffix before, and the rest,
with the bytes to the left of the anchor beside it. A task that receives the runs of a bucket of anchors combines them
with a loser tree that knows the common prefix of each head with the last suffix put out; the tree compares bytes only
beyond it. In the sorted order, suffixes that share a prefix are neighbours, and for each split of MATCH bytes into bytes
left and right of the anchor the least doc_id of equal strings follows from the common prefixes and the left contexts.

Defined cases: null and empty texts have no bytes; texts under MATCH bytes stay whole; of equal texts the one with the
smallest doc_id stays; overlaps within one document do not count; rows that repeat a doc_id with its text are alike; an
empty table gives no rows; very long texts are hashed in segments and compared whole. doc_id must not be null or name
different texts. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import runs
from .shared import byte_texts, drop_tables, filter_of, id_and_text, marked, mix64, slices, write_table

MATCH, SEED = 50, 16
LEFT = MATCH - SEED
BUCKET_BYTES = 8 << 20
FLUSH_BYTES = 12 << 20
RUN_ROWS = 100_000
#: Level of compression of the runs.
ZSTD = 3
#: Text bytes hashed together; the hashes take some sixty times as much. A longer text is hashed in segments.
SLICE = 1 << 20
_MOST = np.uint64(2**64 - 1)


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of width values from each place on; shorter by width - 1."""
    f = np.minimum if least else np.maximum
    span = 1
    while 2 * span <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of each anchor. A long text is looked at in segments, each with the bytes that decide on its anchors."""
    if sum(map(len, texts)) <= 2 * SLICE:
        return anchors_of(texts)
    parts = []
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text)), SLICE):
            low = max(0, a - LEFT)
            _, place, h = anchors_of([text[low : a + SLICE + MATCH]])
            place = place + low
            own = (place >= a) & (place < a + SLICE)
            parts.append((np.full(int(own.sum()), i), place[own], h[own]))
    owner, place, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return owner, place, h


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of each anchor of texts held together."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(sizes.sum())
    none = np.zeros(0, np.int64)
    if not (sizes >= MATCH).any():
        return none, none, none.astype(np.uint64)
    raw = b"".join(texts) + bytes(MATCH + 16)
    words = np.empty(n + MATCH, np.uint64)
    for k in range(8):
        part = np.frombuffer(raw, "<u8", (len(words) - k + 7) // 8, k)
        words[k::8] = part[: len(words[k::8])]
    h = mix64(words[: n + LEFT] + mix64(words[8 : n + LEFT + 8])) | np.uint64(1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    edge = np.zeros(n + 1, np.int32)  # places too near to the end of their text, for a seed and for a whole match
    for size, blank in ((SEED, True), (MATCH, False)):
        edge[:] = 0
        a = np.maximum(starts, ends - size + 1)
        np.add.at(edge, a, 1)
        np.add.at(edge, ends, -1)
        out = np.cumsum(edge[:n]) > 0
        if blank:
            h[:n][out] = _MOST
            h[n:] = _MOST
        else:
            least = sliding(h, LEFT + 1, True)[:n]
            least[out] = 0
    most = sliding(np.concatenate([np.zeros(LEFT, np.uint64), least]), LEFT + 1, False)
    at = np.flatnonzero((most == h[:n]) & (h[:n] != _MOST))
    owner = np.searchsorted(ends, at, side="right")
    return owner, at - starts[owner], h[at]


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """same (the hash of a text), anchors (hashes, uint64): those anchors of a text that another text has too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        size, batch_number = 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            c, h = np.concatenate(same), np.concatenate(hashes)
            order = np.lexsort((c, h, h % np.uint64(buckets)))
            c, h = c[order], h[order]
            first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ _MOST))
            last = np.append(first[1:], len(h)) - 1
            many = c[first] != c[last[: len(first)]] if len(h) else np.zeros(0, bool)
            known = np.repeat(many, np.diff(first, append=len(h)))  # what meets here already needs no answer
            numbers, kinds, blobs = [int(mix64(np.uint64([batch_number]))[0] % np.uint64(buckets))], [1], [c[known].tobytes() + h[known].tobytes()]
            c, h = c[first], h[first]  # others only have to know that this anchor is there, and whether in two texts
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, which = np.unique(c[a:b], return_inverse=True)
                width = "<u2" if len(own) <= 1 << 16 else "<u4"
                six = h[a:b].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()  # 48 of its bits
                numbers.append(int(bucket[a]))
                kinds.append(0)
                blobs.append(np.asarray([b - a, len(own)], "<u4").tobytes() + own.tobytes() + which.astype(width).tobytes() + six + np.packbits(many[a:b]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([batch_number] * len(blobs), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "batch", "kind", "blob"])
            same.clear()
            hashes.clear()

        for batch in slices(batches, limit=SLICE):
            texts = byte_texts(batch.column("text"))
            owner, _, h = anchors(texts)
            same.append(batch.column("same").to_numpy()[owner].view(np.uint64))
            hashes.append(h)
            size += sum(map(len, texts))
            if size >= FLUSH_BYTES:
                yield from flush()
                size, batch_number = 0, batch_number + 1
        if hashes:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One answer to each batch that sent something: texts and those of their anchors that another text has."""
        for group in runs(batches, ["bucket", "kind"]):
            if group.column("kind")[0].as_py():
                yield from group.select(["batch", "blob"]).to_batches()
                continue
            c, h, met, sizes = [], [], [], []
            for blob in group.column("blob").to_pylist():
                n, m = np.frombuffer(blob, "<u4", 2).tolist()
                own = np.frombuffer(blob, np.uint64, m, 8)
                width = "<u2" if m <= 1 << 16 else "<u4"
                at = 8 + 8 * m
                c.append(own[np.frombuffer(blob, width, n, at)])
                at += n * np.dtype(width).itemsize
                six = np.zeros((n, 8), np.uint8)
                six[:, 2:] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(-1, 6)
                h.append(six.view(np.uint64).ravel())
                met.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + 6 * n), count=n).astype(bool))
                sizes.append(n)
            c, h, met = np.concatenate(c), np.concatenate(h), np.concatenate(met)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] ^ _MOST))
            many = (np.minimum.reduceat(c[order], first) != np.maximum.reduceat(c[order], first)) | np.logical_or.reduceat(met[order], first)
            there = np.empty(len(h), bool)
            there[order] = np.repeat(many, np.diff(first, append=len(h)))
            there &= ~met  # its sender knows that
            numbers, blobs = [], []
            ends = np.cumsum(sizes).tolist()
            for number, n, b in zip(group.column("batch").to_pylist(), sizes, ends, strict=True):
                some = there[b - n : b]
                if some.any():
                    numbers.append(number)
                    blobs.append(c[b - n : b][some].tobytes() + h[b - n : b][some].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], ["batch", "blob"])

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The answers of all buckets to a batch, by text."""
        for group in runs(batches, ["batch"]):
            blobs = group.column("blob").to_pylist()
            c = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 16) for x in blobs])
            h = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 16, len(x) // 2) for x in blobs])
            order = np.argsort(c, kind="stable")
            c, h = c[order], h[order]
            if not len(c):
                continue
            cuts = np.flatnonzero(np.diff(c, prepend=c[:1] ^ _MOST)).tolist() + [len(c)]
            raw = memoryview(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c[cuts[:-1]].view(np.int64)), pa.array([bytes(raw[8 * a : 8 * b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["same", "anchors"])

    sent = docs.mapInArrow(send, "bucket long, batch long, kind int, blob binary")
    met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(meet, "batch long, blob binary")
    return met.repartition("batch").sortWithinPartitions("batch").mapInArrow(sort_out, "same long, anchors binary")


def shared_lengths(wide: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before."""
    differ = wide[1:] != wide[:-1]
    return np.concatenate([np.zeros(min(1, len(wide)), np.int64), np.where(differ.any(axis=1), differ.argmax(axis=1), wide.shape[1])])


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Length shared with the string before (trailing zero bytes count as there), and the rests in a row. The strings are sorted."""
    wide = np.frombuffer(b"".join(s.ljust(MATCH, b"\0") for s in strings), np.uint8).reshape(-1, MATCH)
    shared = shared_lengths(wide)
    return shared, b"".join(s[k:] for s, k in zip(strings, shared.tolist(), strict=True))


class Suffixes:
    """Suffixes as rows of arrays: MATCH bytes from an anchor on, the LEFT bytes before it backwards, how many of these the text has, doc id, place. Bytes beyond a text are zero."""

    NAMES = ("right", "left", "n_right", "n_left", "doc", "place")

    def __init__(self, right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, doc: np.ndarray, place: np.ndarray) -> None:
        self.right, self.left, self.n_right, self.n_left, self.doc, self.place = right, left, n_right, n_left, doc, place

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, at) -> Suffixes:
        return Suffixes(*(getattr(self, k)[at] for k in self.NAMES))

    @classmethod
    def together(cls, parts: list[Suffixes]) -> Suffixes:
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in cls.NAMES))

    @classmethod
    def of(cls, texts: list[bytes], owner: np.ndarray, place: np.ndarray, docs: np.ndarray) -> Suffixes:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(bytes(LEFT) + b"".join(texts) + bytes(MATCH), np.uint8)
        at = (np.cumsum(sizes) - sizes)[owner] + place + LEFT
        n_right, n_left = np.minimum(sizes[owner] - place, MATCH).astype(np.uint8), np.minimum(place, LEFT).astype(np.uint8)
        right = np.lib.stride_tricks.sliding_window_view(raw, MATCH)[at]
        left = np.lib.stride_tricks.sliding_window_view(raw, LEFT)[at - LEFT][:, ::-1]
        return cls(np.where(np.arange(MATCH) < n_right[:, None], right, np.uint8(0)), np.where(np.arange(LEFT) < n_left[:, None], left, np.uint8(0)), n_right, n_left, docs[owner], place)

    def dump(self) -> bytes:
        """The rows, sorted by `right`, front-coded; ids and places by byte planes, as their high bytes are alike; and all of it compressed."""
        shared = shared_lengths(self.right)
        rest = self.right[(np.arange(MATCH) >= shared[:, None]) & (np.arange(MATCH) < self.n_right[:, None])]
        left = self.left[np.arange(LEFT) < self.n_left[:, None]]
        planes = [np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in (self.doc, self.place)]
        raw = b"".join([np.asarray([len(self), len(rest)], "<u4").tobytes(), *planes, self.n_right.tobytes(), self.n_left.tobytes(), shared.astype(np.uint8).tobytes(), rest.tobytes(), left.tobytes()])
        return np.asarray([len(raw)], "<u8").tobytes() + pa.Codec("zstd", ZSTD).compress(raw, asbytes=True)

    @classmethod
    def load(cls, blob: bytes) -> tuple[Suffixes, bytes]:
        """The rows, and the length that each shares with the one before."""
        blob = pa.Codec("zstd").decompress(memoryview(blob)[8:], int(np.frombuffer(blob, "<u8", 1)[0]), asbytes=True)
        n, m = np.frombuffer(blob, "<u4", 2).tolist()
        doc, place = (np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, 8 + k * 8 * n).reshape(8, n).T).view("<i8").ravel() for k in range(2))
        at = 8 + 16 * n
        n_right, n_left, shared = (np.frombuffer(blob, np.uint8, n, at + k * n) for k in range(3))
        at += 3 * n
        right, left = np.zeros((n, MATCH), np.uint8), np.zeros((n, LEFT), np.uint8)
        right[(np.arange(MATCH) >= shared[:, None]) & (np.arange(MATCH) < n_right[:, None])] = np.frombuffer(blob, np.uint8, m, at)
        left[np.arange(LEFT) < n_left[:, None]] = np.frombuffer(blob, np.uint8, offset=at + m)
        row = np.arange(n)
        for k in range(MATCH):  # each byte from the last row that has its own
            right[:, k] = right[np.maximum.accumulate(np.where(shared <= k, row, 0)), k]
        return cls(right, left, n_right, n_left, doc, place), shared.tobytes()

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last number of bytes left of the anchor in strings of MATCH bytes."""
        return np.maximum(MATCH - self.n_right.astype(np.int64), 0), np.minimum(self.n_left.astype(np.int64), LEFT)


def stretches(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (doc, start, end) of maximal stretches, by document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    which = np.cumsum(np.diff(doc, prepend=doc[:1]) != 0)
    far = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + which * far) - which * far  # of this document only, for places stay under `far`
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return np.stack([doc[first], start[first], reach[last[: len(first)]]], axis=1).astype("<i8")


def suffix_runs(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, kind, run. Kind 0: sorted, front-coded suffixes from the shared anchors of a task's texts. Kind 1: stretches (of a share of the documents) whose whole surroundings a smaller document of the same task has; these suffixes need not be sent. found: doc_id, text, anchors (list of binary)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Suffixes] = []
        marks: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows, bucket = Suffixes.together(held), np.concatenate(marks)
            if not len(rows):
                return
            key = np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), rows.right, rows.n_right[:, None], rows.left, rows.n_left[:, None], (rows.doc.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)], axis=1)
            order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
            key, rows, bucket = key[order, :-8], rows.take(order), bucket[order]
            first = np.ones(len(rows), bool)
            first[1:] = (key[1:] != key[:-1]).any(axis=1)
            least = rows.doc[np.flatnonzero(first)][np.cumsum(first) - 1]
            gone = rows.doc > least
            numbers, kinds, blobs = [], [], []
            if gone.any():
                some = rows.take(gone)
                low, high = some.windows()
                some, low, high = some.take(low <= high), low[low <= high], high[low <= high]
                spans = stretches(some.doc, some.place - high, some.place - low + MATCH)
                numbers, blobs = shared_out(spans, buckets)
                kinds = [1] * len(numbers)
            rows, bucket = rows.take(~gone), bucket[~gone]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                numbers.append(int(bucket[a]))
                kinds.append(0)
                blobs.append(rows.take(slice(a, b)).dump())
            held.clear()
            marks.clear()
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "run"])

        for batch in slices(batches, limit=SLICE):
            texts = byte_texts(batch.column("text"))
            owner, place, h = anchors(texts)
            h48 = h & np.uint64(0xFFFFFFFFFFFF0000)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            wanted = np.zeros(len(owner), bool)
            for i, blobs in enumerate(batch.column("anchors").to_pylist()):
                wanted[cuts[i] : cuts[i + 1]] = np.isin(h48[cuts[i] : cuts[i + 1]], np.frombuffer(b"".join(blobs), np.uint64) & np.uint64(0xFFFFFFFFFFFF0000))
            held.append(Suffixes.of(texts, owner[wanted], place[wanted], batch.column("doc_id").to_numpy()))
            marks.append((h48[wanted] % np.uint64(buckets)).astype(np.int64))
            if sum(map(len, held)) >= RUN_ROWS:
                yield from flush()
        if held:
            yield from flush()

    return found.mapInArrow(send, "bucket long, kind int, run binary")


def shared_out(spans: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Rows (doc, start, end) by share of the documents."""
    share = (mix64(spans[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    sort = np.argsort(share, kind="stable")
    share, spans = share[sort], spans[sort]
    cuts = np.flatnonzero(np.diff(share, prepend=-1, append=buckets)).tolist()
    return share[cuts[:-1]].tolist(), [spans[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


class Rows:
    """The rows of an array of bytes, each made when it is asked for."""

    def __init__(self, wide: np.ndarray) -> None:
        self.raw, self.n, self.width = wide.tobytes(), len(wide), wide.shape[1]

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> bytes:
        return self.raw[i * self.width : (i + 1) * self.width]


def merge(strings: Sequence[Sequence[bytes]], shared: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The order (rows of run, place in it) of all strings of sorted runs, and the length that each shares with the one before.

    A loser tree. Every head has the length that it shares with the last string put out. Of two heads the one that shares
    more is the smaller and the other keeps its length; only with equal lengths are bytes compared, from there on, and the
    loser then shares with the winner as far as they agree. The next head of the winner's run comes with its length, which
    the front coding has. Shorter strings count as ending in zero bytes; ties go to the run that comes first.
    """
    k = 1
    while k < max(1, len(strings)):
        k *= 2
    heads: list[bytes | None] = [s[0].ljust(MATCH, b"\0") if s else None for s in strings] + [None] * (k - len(strings))
    same = [0] * k
    at = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; a comes before b."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = same[a], same[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        if x == y:
            same[b] = MATCH
            return a, b
        while x[p] == y[p]:
            p += 1
        if x[p] < y[p]:
            same[b] = p
            return a, b
        same[a] = p
        return b, a

    losers = [0] * k
    level = list(range(k))
    width = k
    while width > 1:
        above = []
        for i in range(0, width, 2):
            won, lost = play(level[i], level[i + 1])
            losers[(width + i) // 2] = lost
            above.append(won)
        level = above
        width //= 2
    winner = level[0]
    order, lengths = array("q"), array("B")
    while heads[winner] is not None:
        run = winner
        order.append(run)
        order.append(at[run])
        lengths.append(same[run])
        i = at[run] = at[run] + 1
        if i < len(strings[run]):
            heads[run] = strings[run][i].ljust(MATCH, b"\0")
            same[run] = shared[run][i]
        else:
            heads[run] = None
        node = (k + run) // 2
        while node:
            other = losers[node]
            won, lost = play(run, other) if run < other else play(other, run)
            losers[node] = lost
            run = won
            node //= 2
        winner = run
    return np.asarray(order).reshape(-1, 2), np.asarray(lengths)


def repeated_spans(sent: DataFrame, buckets: int) -> DataFrame:
    """doc_id, spans (int64 pairs): stretches of each document that smaller documents have, as far as this bucket's anchors tell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket", "kind"]):
            if group.column("kind")[0].as_py():
                yield from group.select(["bucket", "run"]).rename_columns(["share", "found"]).to_batches()
                continue
            parts, shared = zip(*(Suffixes.load(x) for x in group.column("run").to_pylist()), strict=True)
            del group
            order, lengths = merge([Rows(p.right) for p in parts], shared)
            base = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            rows = Suffixes.together(parts).take(base[order[:, 0]] + order[:, 1])
            del parts, shared, order
            doc, n = rows.doc, len(rows)
            by_left = np.argsort(np.ascontiguousarray(rows.left).view(f"S{LEFT}").ravel(), kind="stable")
            left_shared = shared_lengths(rows.left[by_left])
            low, high = rows.windows()
            start, end = np.zeros((2, n), np.int64)  # strings around one anchor overlap, so their union is one stretch
            same = np.empty(n, np.int64)
            for i in range(LEFT + 1):
                there = np.flatnonzero((high >= i) & (low <= i))
                if not len(there):
                    continue
                same[by_left] = np.cumsum(left_shared < i)  # of equal bytes left of the anchor: by their common prefix
                interval = np.cumsum(lengths < MATCH - i)  # and right of it
                key = interval[there] * (n + 1) + same[there]
                sort = np.argsort(key)
                first = np.flatnonzero(np.diff(key[sort], prepend=-1))
                own = doc[there][sort]
                least = np.repeat(np.minimum.reduceat(own, first), np.diff(first, append=len(own)))
                hit = there[sort[least < own]]
                fresh = hit[end[hit] == 0]
                end[fresh] = rows.place[fresh] - i + MATCH
                start[hit] = rows.place[hit] - i
            some = np.flatnonzero(end)
            if not len(some):
                continue
            share, found = shared_out(stretches(doc[some], start[some], end[some]), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(share, pa.int64()), pa.array(found, pa.binary())], ["share", "found"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches that all buckets found in a share of the documents, by document."""
        for group in runs(batches, ["share"]):
            found = np.frombuffer(b"".join(group.column("found").to_pylist()), "<i8").reshape(-1, 3)
            found = found[np.argsort(found[:, 0], kind="stable")]
            cuts = np.flatnonzero(np.diff(found[:, 0], prepend=found[0, 0] - 1)).tolist() + [len(found)]
            docs = found[cuts[:-1], 0]
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array([found[x:y, 1:].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["doc_id", "spans"])

    found = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(work, "share long, found binary")
    return found.repartition("share").sortWithinPartitions("share").mapInArrow(gather, "doc_id long, spans binary")


def united(blobs: list[bytes]) -> list[tuple[int, int]]:
    """Maximal stretches of the union."""
    pairs = np.concatenate([np.frombuffer(b, "<i8").reshape(-1, 2) for b in blobs])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    start = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > ends[:-1]]))
    return list(zip(pairs[start, 0].tolist(), ends[np.append(start[1:], len(pairs)) - 1].tolist(), strict=True))


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, text, copy, spans: whether a smaller document has the same text, and else the stretches (list of int64 pairs) to remove."""
    docs = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("same", F.xxhash64("text"))
    marks = write_table(docs.select("doc_id", "same", F.crc32("text").alias("crc"), F.octet_length("text").cast("long").alias("size")), "texts")
    classes = marks.groupBy("same", "crc", "size").agg(F.min("doc_id").alias("rep"))
    total = marks.agg(F.sum("size")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    hits = write_table(shared_anchors(docs.where(F.octet_length("text") >= MATCH), buckets).groupBy("same").agg(F.collect_list("anchors").alias("anchors")), "anchors", free=True)
    wanted = write_table(classes.select(F.col("rep").alias("doc_id"), "same").join(hits, "same").select("doc_id", "anchors"), "wanted", free=True)
    drop_tables(hits)
    texts = docs.select("doc_id", "text")
    sent = suffix_runs(marked(texts, "doc_id", filter_of(wanted, "doc_id"), "may").where("may").select("doc_id", "text").join(wanted.hint("merge"), "doc_id"), buckets)
    spans = write_table(repeated_spans(sent, buckets), "spans", free=True)
    drop_tables(wanted)
    copies = marks.where(F.col("size") >= MATCH).join(classes, ["same", "crc", "size"]).where("doc_id > rep").select("doc_id", F.lit(True).alias("copy"), F.lit(None).cast("binary").alias("spans"))
    found = write_table(copies.union(spans.select("doc_id", F.lit(False), "spans")).groupBy("doc_id").agg(F.max("copy").alias("copy"), F.collect_list("spans").alias("spans")), "found")
    told = marked(texts, "doc_id", filter_of(found, "doc_id"), "may")  # only texts that can lose something move
    whole = told.where("not may").select("doc_id", "text", F.lit(None).cast("boolean").alias("copy"), F.lit(None).cast("array<binary>").alias("spans"))
    return whole.union(told.where("may").select("doc_id", "text").join(found.hint("merge"), "doc_id", "left"))


def removed_spans(size: int, copy: bool | None, blobs: list[bytes] | None) -> list[tuple[int, int]]:
    if copy:
        return [(0, size)]
    return united(blobs) if blobs else []


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, copy, blobs in zip(byte_texts(batch.column("text")), batch.column("copy").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = removed_spans(len(text), copy, blobs)
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            n, removed, spans, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, removed, spans)], pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_strings(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept: the remaining bytes of each document (as binary, for a cut can part a character)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, copy, blobs in zip(byte_texts(batch.column("text")), batch.column("copy").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = removed_spans(len(text), copy, blobs)
                edges = [0, *[x for ab in gone for x in ab], len(text)]
                out.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "kept"])

    return repeated_strings(docs).mapInArrow(run, "doc_id long, kept binary")
