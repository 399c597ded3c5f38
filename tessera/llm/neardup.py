"""MinHash near-duplicate detection with min-max hashing.

One pass makes, for each document, its set of distinct word shingles, a 128-bit identity of the set, the minimum and the
maximum of the set under each of PERMUTATIONS permutations, the keys of BANDS bands of ROWS such values, and a bitmap of
the set. Documents with equal sets form a class, which its least doc_id stands for, so copies are never compared.

Classes that share a band key form a bucket. Each member is first compared with the bucket's least member only. Then
components are built, and in buckets that still hold more than one component all pairs between components are tried
against the bitmaps: two sets differ by at least as many shingles as their bitmaps by bits, which rules most pairs out
without error. Buckets beyond TILE members are dealt with as pairs of tiles. Every pair that is left is confirmed on the
full sets, and components of the confirmed links are the result. No pair of a bucket is dropped, and none is made within
a component.

At a similarity of 0.85 a pair shares no band key with a probability of about 1e-5.

Defined cases: null, empty or blank texts have no shingles and link with nothing; a text of fewer words than a shingle is
one shingle of all its words; ties go to the least doc_id; repeated rows share a class; rows without doc_id are compared,
but nothing can stand for them, so they are kept; very long texts are whole; an empty table gives no rows. Other columns
are ignored, and passed on by drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .shared import WordHashes, byte_texts, drop_tables, filter_of, id_and_text, marked, mix64, slices, split_words, starts_of, write_table

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 24, 6
PERMUTATIONS = BANDS * ROWS // 2
BITS, WORDS = 1024, 16
TILE = 2000
#: Pairs that a task holds before it sends them on.
PAIRS = 100_000
SALTS = 64

_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _random.integers(0, 2**63, PERMUTATIONS, np.uint64)
_BAND = _random.integers(0, 2**63, BANDS, np.uint64)


def shingle_sets(texts: list[bytes], known: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text in a row, and how many each has."""
    words, counts = split_words(texts)
    h = known.of(words)
    s = np.zeros(len(h), np.uint64)
    for k in range(width):
        s[: len(h) - k] = mix64(s[: len(h) - k] + h[k:]) if k < len(h) else s[: len(h) - k]
    at = starts_of(counts)
    sets = []
    for i, n in enumerate(counts.tolist()):
        a = int(at[i])
        if n >= width:
            sets.append(np.unique(s[a : a + n - width + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for w in h[a : a + n]:
                x = mix64(x * np.uint64(31) + w)
            sets.append(x)
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.fromiter(map(len, sets), np.int64, len(sets))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, set_a, set_b (identity), keys (of bands), bits. Without shingles keys and bits are null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            every, n = shingle_sets(byte_texts(batch.column("text")), known, width)
            some = np.flatnonzero(n)
            at = starts_of(n)[:-1][some]
            two = np.zeros((2, len(n)), np.uint64)
            keys = np.zeros((len(some), BANDS), np.uint64)
            bits = np.zeros((len(some), WORDS), np.uint64)
            if len(some):
                two[0, some] = np.add.reduceat(mix64(every), at)
                two[1, some] = np.add.reduceat(mix64(every ^ np.uint64(0x5851F42D4C957F2D)), at)
                values = np.empty((2 * PERMUTATIONS, len(some)), np.uint64)
                for k in range(PERMUTATIONS):
                    x = (every ^ _FLIP[k]) * _MULTIPLY[k]
                    values[k] = np.minimum.reduceat(x, at)
                    values[PERMUTATIONS + k] = np.maximum.reduceat(x, at)
                for b in range(BANDS):
                    key = np.full(len(some), _BAND[b])
                    for row in values[b * ROWS : (b + 1) * ROWS]:
                        key = mix64(key * np.uint64(31) + row)
                    keys[:, b] = key
                spot = (every >> np.uint64(64 - 10)).astype(np.int64)
                flat = np.zeros(len(some) * BITS, bool)
                flat[np.repeat(np.arange(len(some)), n[some]) * BITS + spot] = True
                bits = np.packbits(flat).view(np.uint64).reshape(-1, WORDS)
            there = np.zeros(len(n), bool)
            there[some] = True

            def lists(rows: np.ndarray, there: np.ndarray = there) -> pa.Array:
                offsets = np.concatenate([[0], np.cumsum(there * rows.shape[1])]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel().view(np.int64)), mask=pa.array(~there))

            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(two[0].view(np.int64)), pa.array(two[1].view(np.int64)), lists(keys), lists(np.ascontiguousarray(bits))], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n long, set_a long, set_b long, keys array<long>, bits array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, hashes (the sorted shingle hashes) of the documents of these ids. Other texts don't move: a filter tells them first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            every, n = shingle_sets(byte_texts(batch.column("text")), known, width)
            at, raw = starts_of(n).tolist(), memoryview(every.view(np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[8 * a : 8 * b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["doc_id", "hashes"])

    some = marked(docs, "doc_id", filter_of(ids, "doc_id"), "may").where("may").drop("may")
    return some.join(ids.hint("merge"), "doc_id").mapInArrow(run, "doc_id long, hashes binary")  # the same plan at every size


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the similarity. Sets are made once; a task holds that of one `a` and reads its partners in a row."""
    ids = write_table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    sets = write_table(full_sets(docs, ids, width), "sets")
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    other = sets.select(F.col("doc_id").alias("b"), "hashes")
    sides = salted.select("a", "salt", F.lit(1).alias("side"), "b").union(salted.select("a", "salt").distinct().select("a", "salt", F.lit(0), F.col("a")))
    dealt = sides.join(other.hint("merge"), "b").select("a", "salt", "side", "b", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in slices(batches, "hashes"):
            found = []
            for i, (side, raw) in enumerate(zip(batch.column("side").to_pylist(), batch.column("hashes"), strict=True)):
                other = np.frombuffer(raw.as_buffer(), np.uint64)
                if side == 0:
                    own = other.copy()
                else:
                    both = np.count_nonzero(own[np.minimum(np.searchsorted(own, other), max(len(own) - 1, 0))] == other) if len(own) else 0
                    if both and 100 * both >= percent * (len(own) + len(other) - both):
                        found.append(i)
            if found:
                yield batch.select(["a", "b"]).take(pa.array(found))

    links = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(compare, "a long, b long").distinct()
    links = write_table(links, "links")
    drop_tables(ids, sets)
    return links


def possible(left: str, right: str, left_n: str, right_n: str, percent: int):
    """Whether two sets can reach the similarity, by their sizes and bitmaps; never false where they do."""
    a, b = F.col(left_n), F.col(right_n)
    apart = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * apart <= (100 - percent) * (a + b))


def cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in each bucket that size and bitmap allow. rows: key, rep, component, n, bits, m."""
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("rep"), tiles.cast("long")).cast("int")
    dealt = rows.withColumn("tiles", tiles).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "component", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "i", "j"]):
            rep, component, n, tile = (group.column(c).to_numpy() for c in ("rep", "component", "n", "mine"))
            bits = group.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            found, size_now = [], 0
            for k in range(len(rep)):
                if i != j and tile[k] != i:
                    continue
                others = np.flatnonzero((component != component[k]) & ((tile == j) if i != j else (rep > rep[k])))
                if not len(others):
                    continue
                size = n[others]
                others = others[100 * np.minimum(size, n[k]) >= percent * np.maximum(size, n[k])]
                apart = np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1, dtype=np.int64)
                others = others[(100 + percent) * apart <= (100 - percent) * (n[others] + n[k])]
                found.append(np.stack([np.minimum(rep[others], rep[k]), np.maximum(rep[others], rep[k])]))
                size_now += len(others)
                if size_now >= PAIRS:
                    a, b = np.concatenate(found, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    found, size_now = [], 0
            if size_now:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (integers), from batches in the order of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((np.diff(values) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(values[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    docs = id_and_text(docs)
    table = write_table(sketches(docs, width), "sketches")
    classes = table.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    members = write_table(table.select("doc_id", "n", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), "members")
    reps = write_table(table.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n", "keys", "bits"), "reps")
    drop_tables(table)
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("m")).where("m > 1")
    buckets = write_table(keyed.join(shared, "key"), "buckets")
    sizes = reps.select("rep", "n", "bits")
    stars = buckets.where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(sizes.toDF("a", "an", "abits"), "a").join(sizes.toDF("b", "bn", "bbits"), "b").where(possible("abits", "bbits", "an", "bn", percent)).select("a", "b")
    links = confirmed(write_table(stars, "stars"), docs, width, percent)
    part = write_table(connected_components(links), "components")
    placed = buckets.join(part.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rest = write_table(cross_pairs(placed.join(mixed, "key").join(sizes, "rep"), percent), "cross")
    whole = part
    if not rest.isEmpty():
        whole = write_table(connected_components(links.union(confirmed(rest, docs, width, percent))), "components")
    drop_tables(buckets, reps, rest)
    out = members.join(whole.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs of which near_duplicates keeps the id, with all their columns; of repeated rows of an id all stay, and rows without one."""
    kept = near_duplicates(docs, width, percent).where("kept").select(F.col("doc_id").alias("near_duplicates_keeps")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("near_duplicates_keeps")), "left_semi")
