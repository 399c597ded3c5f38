"""Language-model scoring with a gated recurrent network in numpy.

Documents are dealt into chunks by their id, in a fixed order, and tokenised once. Tasks send the distinct word hashes of a
chunk with their training counts, buckets of hashes add them up and send every chunk the counts of its words back; from
then on a chunk is its tokens' ranks. The most frequent tokens, more of them the larger the corpus (kept_tokens), get
outputs of their own in classes by rank; all others are the tail class. A gated recurrent unit predicts the class of the
next token and, in a second softmax, the token within its class; within the tail, words follow their smoothed counts, and
one share, the tail tokens that occur once (the Good-Turing estimate), is for words never met in training.

Training is truncated backpropagation through WINDOW steps with state carried on, over all training documents: each
chunk trains a copy on its documents, cut into streams of equal length, the copies are averaged by their tokens, and the
average starts the next round; every training document is used in one round. Scoring carries the state from the first to
the last token of a document, and runs documents of similar length side by side.

Defined cases: a null or empty text is its end token alone; equal texts get equal scores; without training documents every
probability is that of an unknown token; an empty table gives no rows; repeated rows are documents of their own, with equal
scores; a null doc_id trains and is scored like any other; a very long text is tokenised in pieces and never fills a grid
beyond five times its tokens. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import runs
from .shared import SLICE_BYTES, WordHashes, byte_texts, drop_tables, id_and_text, mix64, slices, split_words, starts_of, write_table

LEAST_KEPT, ROOT_KEPT, HIDDEN = 1024, 18, 16
STREAMS, WINDOW, RATE = 512, 16, 0.01
#: Shares of the training documents in each round.
ROUNDS = (0.15, 0.85)
CHUNK_BYTES = 8 << 20
#: Tokens of a row of a chunk, about: rows are of moderate size, and only a very long text has a large one.
ROW_TOKENS = 100_000
#: Tokens scored together, and places of a grid that pass the outputs together.
SCORE_TOKENS, SCORE_CELLS = 4_000_000, 16_384
#: Stands for the end of a text among word hashes.
END = np.uint64(0x9E3779B97F4A7C15)
FOLDS, HELD_OUT = 5, 1


def fold(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def token_hashes(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text with its end token, and how many each has."""
    words, counts = split_words(texts)
    out = np.full(len(words) + len(texts), END)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = known.of(words)
    return out, counts + 1


# ---- counts


def long_pieces(text: bytes, limit: int = SLICE_BYTES) -> list[bytes]:
    """The text in pieces of about limit bytes, cut at white space."""
    if len(text) <= limit:
        return [text]
    out, a = [], 0
    while a < len(text):
        b = min(a + limit, len(text))
        while b < len(text) and text[b] not in b" \t\n\v\f\r":
            b += 1
        out.append(text[a:b])
        a = b
    return out


class Chunk:
    """Documents of one chunk: ids, tokens of each, and tokens as places among the chunk's distinct hashes."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.types: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def add(self, batch: pa.RecordBatch, known: WordHashes) -> None:
        texts = byte_texts(batch.column("text"))
        parts = [long_pieces(t) for t in texts]
        whole = len(parts) == sum(map(len, parts))
        for own in [[p] for part in parts for p in part] if not whole else [texts]:  # a very long text piece by piece
            h, counts = token_hashes(own, known)
            types, which = np.unique(h, return_inverse=True)
            self.types.append(types)
            self.places.append(which.astype(np.uint32))
            self.counts.append(counts)
        if not whole:  # only the last piece of a text has an end token
            n = len(texts)
            pieces = self.counts[-sum(map(len, parts)) :]
            del self.counts[-len(pieces) :]
            counts, k = np.zeros(n, np.int64), 0
            for i, part in enumerate(parts):
                for j in range(len(part)):
                    own = int(pieces[k][0]) - (j < len(part) - 1)
                    at = k - len(pieces)
                    self.places[at] = self.places[at][:own]
                    counts[i] += own
                    k += 1
            self.counts.append(counts)
        self.docs += batch.column("doc_id").to_pylist()

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each document, distinct hashes (sorted), their training counts, and the tokens' places."""
        types = np.unique(np.concatenate(self.types))
        places = np.concatenate([np.searchsorted(types, t).astype(np.uint32)[p] for t, p in zip(self.types, self.places, strict=True)])
        counts = np.concatenate(self.counts)
        learns = np.repeat(np.asarray([fold(d) != HELD_OUT for d in self.docs]), counts)
        return counts, types, np.bincount(places[learns], minlength=len(types)).astype(np.int64), places


def encoded(docs: DataFrame, chunks: int, buckets: int) -> DataFrame:
    """side 1 and on: some of a chunk's documents (ids, counts) and their tokens as places (uint32, blob). side 0: a bucket of its distinct hashes (uint64, sorted) and their training counts (int64).

    Which chunk a document is in, and its place there, depend on its id and text and the size of the corpus alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(250_000)
        now, own = None, Chunk()

        def flush() -> Iterator[pa.RecordBatch]:
            counts, types, n, places = own.done()
            ends = np.cumsum(counts)
            cuts = [0, *(np.flatnonzero(np.diff((ends - counts) // ROW_TOKENS)) + 1).tolist(), len(counts)]
            for side, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
                blob = places[ends[a] - counts[a] : ends[b - 1]].tobytes()
                yield pa.RecordBatch.from_pylist([{"side": side, "bucket": None, "chunk": now, "docs": own.docs[a:b], "counts": counts[a:b].tolist(), "blob": blob}], ENCODED)
            place = (mix64(types) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            types, n, place = types[order], n[order], place[order]
            cuts = np.flatnonzero(np.diff(place, prepend=-1, append=buckets)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield pa.RecordBatch.from_pylist([{"side": 0, "bucket": int(place[a]), "chunk": now, "docs": None, "counts": None, "blob": types[a:b].tobytes() + n[a:b].tobytes()}], ENCODED)

        for whole in batches:
            at = whole.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if own.docs and at[a] != now:
                    yield from flush()
                    own = Chunk()
                now = int(at[a])
                for batch in slices(iter([whole.slice(a, b - a)])):
                    own.add(batch, known)
        if own.docs:
            yield from flush()

    placed = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("long"))
    return placed.repartition(chunks, "chunk").sortWithinPartitions("chunk", "doc_id", F.xxhash64("text")).mapInArrow(run, "side int, bucket long, chunk long, docs array<long>, counts array<long>, blob binary")


#: How tables of blobs are written: pages end by their size, not after a hundred rows, and the rows of a chunk are never parted.
BLOBS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 30)}
ENCODED = pa.schema([("side", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("blob", pa.binary())])


def summed_counts(words: DataFrame, kept: int) -> DataFrame:
    """kind 0: chunk and blob (hashes and their corpus-wide counts); 1: blob of token, type and single-count totals; 2: a frequent token and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket"]):
            parts = [(x, len(x) // 16) for x in group.column("blob").to_pylist()]
            h = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in parts])
            c = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in parts])
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] ^ np.uint64(1)))
            total = np.add.reduceat(c[order], first)
            types = h[order][first]
            mine = np.empty(len(h), np.int64)
            mine[order] = np.repeat(total, np.diff(first, append=len(h)))
            ends = np.cumsum([n for _, n in parts]).tolist()
            blobs = [x[: 8 * n] + mine[b - n : b].tobytes() for (x, n), b in zip(parts, ends, strict=True)]
            told = np.asarray([total.sum(), (total > 0).sum(), (total == 1).sum()], np.int64).tobytes()
            top = np.lexsort((types, -total))[:kept]
            top = top[total[top] > 0]
            k = [0] * len(blobs) + [1] + [2] * len(top)
            chunk = group.column("chunk").to_pylist() + [None] * (1 + len(top))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(chunk, pa.int64()), pa.array([*blobs, told, *[None] * len(top)], pa.binary()), pa.array([None] * (len(blobs) + 1) + types[top].view(np.int64).tolist(), pa.int64()), pa.array([None] * (len(blobs) + 1) + total[top].tolist(), pa.int64())], ["kind", "chunk", "blob", "token", "n"])

    return words.select("bucket", "chunk", "blob").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "kind int, chunk long, blob binary, token long, n long")


def one(x: np.ndarray | pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))


def of_types(blobs: list[bytes], v: Vocabulary) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the types of a chunk in the order of their hashes, as its places have them: rank; whether known, base score and tail log10 probability."""
    h = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 16) for x in blobs])
    c = np.concatenate([np.frombuffer(x, np.int64, len(x) // 16, len(x) // 2) for x in blobs])
    order = np.argsort(h)
    h, c = h[order], c[order]
    rank = v.ranks(h)
    return rank.astype(v.dtype), [(c > 0).astype(np.int64), v.base_log10(c), np.where(rank == len(v.hashes), v.tail_log10(c), 0.0)]


RANKED = "chunk long, side int, docs array<long>, counts array<long>, known array<long>, base array<double>, tail array<double>, ranks binary"


def ranked(table: DataFrame, counted: DataFrame, v: Vocabulary, chunks: int) -> DataFrame:
    """RANKED, the rows of each chunk in its order: per document its tokens, known tokens, base score and the log10 probabilities of its tail tokens within the tail; and the rank of every token (v.dtype)."""
    sent = table.sparkSession.sparkContext.broadcast(v)
    none = F.lit(None)
    replies = counted.where("kind = 0").select(F.lit(0).alias("side"), "chunk", none.cast("array<long>").alias("docs"), none.cast("array<long>").alias("counts"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        now, blobs, known = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, side, blob = (batch.column(c)[k] for c in ("chunk", "side", "blob"))
                chunk, blob = chunk.as_py(), blob.as_buffer()
                if side.as_py() == 0:
                    if chunk != now:
                        now, blobs, known = chunk, [], None
                    blobs.append(bytes(blob))
                    continue
                if known is None:
                    known, blobs = of_types(blobs, v), []
                rank, values = known
                counts = batch.column("counts").slice(k, 1).flatten()
                places, first = np.frombuffer(blob, np.uint32), starts_of(counts.to_numpy())[:-1]
                sums = [one(np.add.reduceat(x[places], first)) for x in values]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([side.as_py()], pa.int32()), one(batch.column("docs").slice(k, 1).flatten()), one(counts), *sums, pa.array([rank[places].tobytes()], pa.binary())], ["chunk", "side", "docs", "counts", "known", "base", "tail", "ranks"])

    rows = replies.union(table.where("side > 0").select("side", "chunk", "docs", "counts", "blob"))
    return rows.repartition(chunks, "chunk").sortWithinPartitions("chunk", "side").mapInArrow(run, RANKED)


class Vocabulary:
    """The kept tokens by rank, and totals over training tokens."""

    def __init__(self, tokens: list[tuple[int, int]], total: int, types: int, singles: int) -> None:
        self.total, self.types = total, types
        self.hashes = np.asarray([t for t, _ in tokens], np.int64).view(np.uint64)
        self.counts = np.asarray([n for _, n in tokens], np.float64)
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.tail = total - self.counts.sum()
        self.tail_types = types - len(tokens)
        self.unseen = min(0.9, max(0.01, (singles - (self.counts == 1).sum()) / self.tail)) if self.tail else 1.0
        self.dtype = np.uint16 if len(tokens) < 1 << 16 else np.uint32  # of ranks
        self.class_size = 1 << round(math.log2(max(1024, len(tokens))) / 2)
        self.classes = -(-max(1, len(tokens)) // self.class_size)  # the tail class comes after these
        self.end = self.ranks(np.asarray([END]))[0]

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank of each token; len(hashes) for those of the tail."""
        if not len(self.sorted):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], len(self.sorted))

    def tail_log10(self, c: np.ndarray) -> np.ndarray:
        """log10 probability within the tail of words with these counts."""
        mass = self.tail + 0.5 * self.tail_types
        known = np.log10(np.maximum(c + 0.5, 0.5) * (1 - self.unseen) / max(mass, 0.5))
        return np.where(c > 0, known, math.log10(self.unseen))

    def base_log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))


# ---- network


class Network:
    """Gated recurrent unit; class softmax, and a softmax within each class."""

    NAMES = ("table", "gates", "wc", "bc", "ww", "bw")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.p = arrays

    @classmethod
    def initial(cls, v: Vocabulary, hidden: int = HIDDEN, seed: int = 7) -> Network:
        """Small random weights; the biases give the unigram distribution."""
        rng = np.random.default_rng(seed)
        n, c = len(v.hashes), v.classes
        bw = np.full((c, v.class_size), -20.0)
        bw.ravel()[:n] = np.log(v.counts + 0.5)
        mass = np.append(np.where(bw > -20, np.exp(bw), 0).sum(axis=1), v.tail + 0.5)
        f = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
        return cls({"table": f(n + 1, 3 * hidden), "gates": f(hidden, 3 * hidden), "wc": f(hidden, c + 1, scale=0.05), "bc": np.log(np.maximum(mass, 1e-9) / max(mass.sum(), 1e-9)).astype(np.float32), "ww": f(c, hidden, v.class_size, scale=0.05), "bw": bw.astype(np.float32)})

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Network:
        with np.load(io.BytesIO(raw)) as z:
            return cls({k: z[k] for k in cls.NAMES})

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = h.shape[1]
        g = self.p["table"].take(x, axis=0)
        u = h @ self.p["gates"]
        zr = g[:, : 2 * n] + u[:, : 2 * n]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :n], zr[:, n:]
        new = r * u[:, 2 * n :]
        new += g[:, 2 * n :]
        np.tanh(new, out=new)
        after = h - new
        after *= z
        after += new
        return after, z, r, new, u[:, 2 * n :]

    def outputs(self, h: np.ndarray, rank: np.ndarray, back: bool = False):
        """log probability of each target (natural log, the tail as one token), and with back the gradients of the mean loss."""
        p = self.p
        tail, size = p["bc"].shape[0] - 1, p["ww"].shape[2]
        cls = np.minimum(rank // size, tail)
        cls[rank == p["table"].shape[0] - 1] = tail
        e = h @ p["wc"]
        e += p["bc"]
        e -= e.max(axis=1, keepdims=True)
        every = np.arange(len(h))
        log = e[every, cls]
        np.exp(e, out=e)
        s = e @ np.ones(e.shape[1], np.float32)  # much faster than a sum along short rows
        log -= np.log(s)
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(tail + 1))
        grads = {}
        if back:
            scale = np.float32(1 / max(1, len(h)))
            d = e
            d /= s[:, None]
            d[every, cls] -= 1
            d *= scale
            grads = {"wc": h.T @ d, "bc": d.sum(axis=0), "ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
            dh = d @ p["wc"].T
        ones = np.ones(size, np.float32)
        for k in range(tail):
            rows = order[cuts[k] : cuts[k + 1]]
            if not len(rows):
                continue
            own, at = h.take(rows, axis=0), rank[rows] - k * size
            f = own @ p["ww"][k]
            f += p["bw"][k]
            f -= f.max(axis=1, keepdims=True)
            picked = f[every[: len(rows)], at]
            np.exp(f, out=f)
            t = f @ ones
            log[rows] += picked - np.log(t)
            if back:
                f /= t[:, None]
                f[every[: len(rows)], at] -= 1
                f *= scale
                grads["ww"][k] = own.T @ f
                grads["bw"][k] = f.sum(axis=0)
                dh[rows] += f @ p["ww"][k].T
        return (log, dh, grads) if back else log

    def run(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = True) -> tuple[np.ndarray, np.ndarray, list]:
        """States after each of the steps (rows of inputs), the last state, and what going back needs."""
        states, kept = np.empty((*inputs.shape, h.shape[1]), np.float32), []
        for t in range(len(inputs)):
            before = np.where(fresh[t][:, None], np.float32(0), h)
            h, z, r, new, u = self.step(inputs[t], before)
            states[t] = h
            if keep:
                kept.append((before, z, r, new, u))
        return states, h, kept

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean loss over one window, the state after it, and the sum of log probabilities."""
        states, last, kept = self.run(inputs, fresh, h)
        log, dh_real, grads = self.outputs(states[real], targets[real], back=True)
        out = np.zeros(states.shape, np.float32)
        out[real] = dh_real
        n = h.shape[1]
        d = np.zeros_like(h)
        dg = np.empty((*inputs.shape, 3 * n), np.float32)
        gates = self.p["gates"]
        grads["gates"] = np.zeros_like(gates)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, new, u = kept[t]
            d = d + out[t]
            da = d * (1 - z) * (1 - new * new)
            dg[t, :, :n] = d * (before - new) * z * (1 - z)
            dg[t, :, n : 2 * n] = da * u * r * (1 - r)
            dg[t, :, 2 * n :] = da
            du = dg[t].copy()
            du[:, 2 * n :] *= r
            grads["gates"] += before.T @ du
            d = np.where(fresh[t][:, None], np.float32(0), d * z + du @ gates.T)
        x = inputs.ravel()
        order = np.argsort(x, kind="stable")
        first = np.flatnonzero(np.diff(x[order], prepend=-1))
        grads["table"] = (x[order][first], np.add.reduceat(dg.reshape(-1, 3 * n)[order], first, axis=0))
        return grads, last, float(log.sum())


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(a) for k, a in p.items()}
        self.v = {k: np.zeros_like(a) for k, a in p.items()}

    def update(self, grads: dict) -> None:
        self.t += 1
        rate = self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at = slice(None)
            if isinstance(g, tuple):  # only some rows of a table
                at, g = g
            g = np.clip(g, -1, 1)
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.p[k][at] -= np.float32(rate) * m / (np.sqrt(v) + 1e-6)


def streams_of(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lays texts of these many tokens into `width` streams at most, longest first into the shortest stream: place of each token (-1: none) and whether it begins a text."""
    width = max(1, min(width, len(counts)))
    start = starts_of(counts)[:-1]
    heap = [(0, k) for k in range(width)]
    lengths = [0] * width
    column, row = np.empty(len(counts), np.int64), np.empty(len(counts), np.int64)
    for i in np.argsort(-counts, kind="stable").tolist():
        load, k = heap[0]
        column[i], row[i] = k, load
        lengths[k] = load + int(counts[i])
        heapq.heapreplace(heap, (lengths[k], k))
    grid = np.full((max(lengths), width), -1, np.int32)
    fresh = np.zeros(grid.shape, bool)
    fresh[row, column] = True
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(int(counts.sum())) - start[owner]
    grid[row[owner] + within, column[owner]] = np.arange(len(owner))
    return grid, fresh


def even_streams(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As streams_of, but all texts in a row are cut into streams of equal length, which may begin within a text."""
    n = int(counts.sum())
    rows = -(-n // width)
    grid = np.full(rows * width, -1, np.int32)
    grid[:n] = np.arange(n)
    starts = np.zeros(rows * width, bool)
    starts[starts_of(counts)[:-1]] = True
    grid, starts = grid.reshape(width, rows).T, starts.reshape(width, rows).T
    starts[:1] = True
    return grid, starts


def windows(ranks: np.ndarray, counts: np.ndarray, end: int, width: int, steps: int, even: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Inputs, targets, fresh, real and token places of successive windows over streams of the texts."""
    grid, fresh = (even_streams if even else streams_of)(counts, width)
    before = np.concatenate([[end], ranks[:-1]])
    before[starts_of(counts)[:-1]] = end
    for t in range(0, len(grid), steps):
        at = grid[t : t + steps]
        real = at >= 0
        yield np.where(real, before[at], end), np.where(real, ranks[at], 0), fresh[t : t + steps], real, at


# ---- training and scoring


def trained(table: DataFrame, v: Vocabulary, rounds: tuple[float, ...] = ROUNDS, rate: float = RATE, hidden: int = HIDDEN) -> Network:
    """The network after all rounds. In a round each chunk of the RANKED table trains a copy on its share of documents, and the copies are averaged.

    Chunks don't depend on how Spark deals the rows, and sums are in double precision, so neither do the scores. A task
    sends one sum for all its chunks; sums are added in groups, and only the groups' come to the driver.
    """
    spark = table.sparkSession
    model = Network.initial(v, hidden)
    low = 0.0
    for part in rounds:
        sent = spark.sparkContext.broadcast((model.dump(), v))
        span = (int(round(low * 10_000)), int(round((low + part) * 10_000)))
        low += part

        def chosen(batches: Iterator[pa.RecordBatch], dtype: type, span=span) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """chunk, token counts and ranks of the documents of this round, row by row."""
            for batch in batches:
                for k in range(batch.num_rows):
                    docs, counts = (batch.column(c)[k].as_py() for c in ("docs", "counts"))
                    share = mix64(np.asarray([0 if d is None else d for d in docs], np.int64).view(np.uint64)) % np.uint64(10_000)
                    own = (share >= span[0]) & (share < span[1]) & np.asarray([fold(d) != HELD_OUT for d in docs])
                    counts = np.asarray(counts)
                    yield batch.column("chunk")[k].as_py(), counts[own], np.frombuffer(batch.column("ranks")[k].as_buffer(), dtype)[np.repeat(own, counts)].astype(np.int32)

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            raw, v = sent.value
            total, n = None, 0
            for _, rows in groupby(chosen(batches, v.dtype), key=lambda r: r[0]):
                _, counts, ranks = zip(*rows, strict=True)
                counts, ranks = np.concatenate(counts), np.concatenate(ranks)
                if not len(ranks):
                    continue
                copy = Network.load(raw)
                adam, state = Adam(copy.p, rate), np.zeros((STREAMS, hidden), np.float32)
                for inputs, targets, fresh, real, _ in windows(ranks, counts, v.end, STREAMS, WINDOW, even=True):
                    grads, state, _ = copy.gradients(inputs, targets, fresh, real, state)
                    adam.update(grads)
                n += len(ranks)
                total = {k: len(ranks) * a.astype(np.float64) + (0 if total is None else total[k]) for k, a in copy.p.items()}
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([Network(total).dump()], pa.binary()), pa.array([n])], ["model", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                for raw, m in zip(batch.column("model").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    total = {k: a + (0 if total is None else total[k]) for k, a in Network.load(raw).p.items()}
                    n += m
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([Network(total).dump()], pa.binary()), pa.array([n])], ["model", "n"])

        sums = write_table(table.select("chunk", "docs", "counts", "ranks").mapInArrow(train, "model binary, n long"), "models")
        groups = sums.repartition(math.isqrt(sums.count()) + 1).mapInArrow(add, "model binary, n long").collect()  # about the root of the number of tasks
        drop_tables(sums)
        if groups:
            n, total = sum(r.n for r in groups), None
            for r in groups:
                total = {k: a + (0 if total is None else total[k]) for k, a in Network.load(bytes(r.model)).p.items()}
            model = Network({k: (a / n).astype(np.float32) for k, a in total.items()})
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def kept_tokens(size: int) -> int:
    """Tokens with an output of their own for a corpus of so many bytes: more for a larger one, with the fourth root."""
    return max(LEAST_KEPT, -(-round(ROOT_KEPT * size**0.25) // 64) * 64)


def scores(docs: DataFrame, kept: int | None = None, rounds: tuple[float, ...] = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """SCORES of each document."""
    docs = id_and_text(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = kept or kept_tokens(size)
    chunks = max(8, -(-size // chunk_bytes))
    buckets = max(8, chunks // 8)
    table = write_table(encoded(docs, chunks, buckets), "tokens", **BLOBS)
    counted = write_table(summed_counts(table.where("side = 0"), kept), "counts")
    totals = np.zeros(3, np.int64)
    for r in counted.where("kind = 1").select("blob").toLocalIterator():
        totals += np.frombuffer(bytes(r.blob), np.int64)
    top = counted.where("kind = 2").orderBy(F.desc("n"), "token").limit(kept).collect()
    v = Vocabulary([(r.token, r.n) for r in top], *map(int, totals))
    rows = write_table(ranked(table, counted, v, chunks), "ranks", **BLOBS)
    drop_tables(table, counted)
    model = trained(rows, v, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((model.dump(), v))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, v = sent.value
        own = Network.load(raw)
        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                docs, counts, known, base, tail = (batch.column(c)[k].values for c in ("docs", "counts", "known", "base", "tail"))
                waiting.append((docs.to_pylist(), *(x.to_numpy() for x in (counts, known, base, tail)), np.frombuffer(batch.column("ranks")[k].as_buffer(), v.dtype)))
                size += len(waiting[-1][-1])
                if size >= SCORE_TOKENS:
                    yield scored(waiting, own, v)
                    waiting, size = [], 0
        if waiting:
            yield scored(waiting, own, v)

    return rows.mapInArrow(score, SCORES)


def length_groups(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Texts of similar length together (within a factor of four), so that a grid of streams has few empty places."""
    level = (np.log2(np.maximum(counts, 1)) // 2).astype(np.int64)
    for k in np.unique(level).tolist():
        yield np.flatnonzero(level == k)


def scored(waiting: list[tuple], model: Network, v: Vocabulary) -> pa.RecordBatch:
    ids = [d for w in waiting for d in w[0]]
    counts, known, base, score, ranks = (np.concatenate([w[k] for w in waiting]) for k in range(1, 6))
    score, ranks = score.copy(), ranks.astype(np.int32)
    starts = starts_of(counts)
    for group in length_groups(counts):
        own = counts[group]
        at = np.repeat(starts[group] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        log = np.zeros(len(at), np.float32)
        state, steps = None, max(32, SCORE_CELLS // min(STREAMS, len(group)))
        for inputs, targets, fresh, real, places in windows(ranks[at], own, v.end, STREAMS, steps):
            if state is None:
                state = np.zeros((inputs.shape[1], model.p["gates"].shape[0]), np.float32)
            some = real.any(axis=0)
            states, state[some], _ = model.run(inputs[:, some], fresh[:, some], state[some], keep=False)
            real = real[:, some]
            log[places[:, some][real]] = model.outputs(states[real], targets[:, some][real]) / np.float32(math.log(10))
        score[group] += np.add.reduceat(log.astype(np.float64), np.cumsum(own) - own)
    columns = [pa.array(ids, pa.int64()), pa.array([fold(d) == HELD_OUT for d in ids]), pa.array(counts), pa.array(known), pa.array(np.full(len(counts), v.total)), pa.array(base), pa.array(score)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
