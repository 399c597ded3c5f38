"""Sharding: minimax contiguous partition over ordered atomic groups.

Documents of equal text form an atomic group; groups are ordered by the 64-bit hash of the text. The smallest capacity
for which a greedy sweep needs at most n shards is found by binary search, and the shards are cut there. The group
sizes never come to the driver as a whole: it sees sums over ranges of the hash, at first 65,536 ranges, and asks for
finer sums only where a cut can lie. A cut lies between what the sweep reaches with the lower bound of the capacity over
unsplit ranges and with the upper bound over ranges taken as divisible; refining these places until they hold single
groups makes the search exact, and the sums asked for stay a few thousand a step at any size of the corpus. Groups with
a large share of all bytes are ranges of their own from the start.

Slots count the rows of a shard in the order of (hash, doc_id): a range-partitioned, sorted table gives each row its
place in its partition, and the counts of earlier partitions are added.

Defined cases: a null text has no bytes; all equal texts share a shard, however many; with fewer groups than shards some
shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_table

SHARDS = 24
ROW_BYTES = 8
FIRST_BITS, STEP_BITS = 16, 8

#: lowest and highest hash, bytes, groups, bytes of the largest group
Range = tuple[int, int, int, int, int]


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, place (the hash of the text, as a number from 0)."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("place"),
    )


def heavy_groups(rows: DataFrame, share: int) -> list[int]:
    """Hashes of the groups with at least one share-th of all bytes: share of them at most."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = rows.groupBy("place").agg(F.sum("size").alias("size")).where(F.col("size") * share >= total)
    return sorted(r.place for r in large.select("place").collect()) if total else []


def summed(rows: DataFrame, bits: int, heavy: list[int], within: list[tuple[int, int]] | None = None) -> list[Range]:
    """Sums over ranges of the hash that share their first `bits` bits, in order; a heavy group is a range of its own and parts its range.

    within: only these hashes, one stretch for each cut at most.
    """
    if within is not None:
        condition = F.lit(False)
        for a, b in within:
            condition = condition | F.col("place").between(a, b)
        rows = rows.where(condition)
    groups = rows.groupBy("place").agg(F.sum("size").alias("size")).withColumn("first", F.shiftright("place", 64 - bits))
    if heavy:
        split = F.col("first").isin([h >> (64 - bits) for h in heavy])
        below = F.size(F.filter(F.array(*map(F.lit, heavy)), lambda h: h <= F.col("place")))
        part = F.when(split, 2 * below - F.col("place").isin(heavy).cast("int")).otherwise(0)
    else:
        part = F.lit(0)
    by = groups.groupBy("first", part.alias("part")).agg(F.min("place").alias("low"), F.max("place").alias("high"), F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most"))
    return sorted((r.low, r.high, r["size"], r.n, r.most) for r in by.collect())


def sweep(ranges: list[Range], capacity: int, shards: int) -> list[int]:
    """For each shard in turn, how many ranges a greedy sweep has passed. A range beyond the capacity ends the sweep."""
    ends, i = [], 0
    for _ in range(shards):
        load = 0
        while i < len(ranges) and load + ranges[i][2] <= capacity:
            load += ranges[i][2]
            i += 1
        ends.append(i)
    return ends


def near_sweep(ranges: list[Range], capacity: int, shards: int) -> list[int]:
    """Ranges that a sweep over the groups has surely passed. Two shards in a row hold more than the capacity, which gets it past a large range."""
    ends, i, stuck = [], 0, 0
    for _ in range(shards):
        load = 0
        while i < len(ranges) and load + ranges[i][2] <= capacity:
            load += ranges[i][2]
            i += 1
        if not load and i < len(ranges):
            stuck += 1
            if stuck == 2 * -(-ranges[i][2] // capacity):
                i, stuck = i + 1, 0
        ends.append(i)
    return ends


def far_sweep(ranges: list[Range], capacity: int, shards: int) -> list[int]:
    """Ranges that a sweep over the groups may have entered: ranges of several groups are taken as divisible."""
    ends, i, taken = [], 0, 0
    for _ in range(shards):
        load = 0
        while i < len(ranges):
            rest = ranges[i][2] - taken
            if load + rest <= capacity:
                load, i, taken = load + rest, i + 1, 0
            else:
                taken += capacity - load if ranges[i][3] > 1 else 0
                break
        ends.append(min(i + 1, len(ranges)))
    return ends


def smallest_capacity(ranges: list[Range], shards: int) -> tuple[int, int]:
    """The lower bound of the capacity, and by binary search the smallest with which the sweep reaches the end."""
    low = bound = max(-(-sum(r[2] for r in ranges) // shards), max(r[4] for r in ranges))
    high = max(low, sum(r[2] for r in ranges))
    while low < high:
        middle = (low + high) // 2
        if sweep(ranges, middle, shards)[-1] == len(ranges):
            high = middle
        else:
            low = middle + 1
    return bound, low


def minimax_cuts(rows: DataFrame, shards: int = SHARDS, first_bits: int = FIRST_BITS, step_bits: int = STEP_BITS) -> list[int]:
    """The highest hash of each shard but the last, for the smallest capacity; rows has place and size."""
    heavy = heavy_groups(rows, 8 * shards)
    bits = first_bits
    ranges = summed(rows, bits, heavy)
    while ranges and bits < 64:
        low, high = smallest_capacity(ranges, shards)
        stretches: list[list[int]] = []
        for a, b in zip(near_sweep(ranges, low, shards), far_sweep(ranges, high, shards), strict=True):
            open_ = [i for i in range(a, b) if ranges[i][3] > 1]
            if open_ and stretches and open_[0] <= stretches[-1][1] + 1:
                stretches[-1][1] = max(stretches[-1][1], open_[-1])
            elif open_:
                stretches.append([open_[0], open_[-1]])
        if not stretches:
            break
        bits = min(64, bits + step_bits)
        finer = summed(rows, bits, heavy, [(ranges[a][0], ranges[b][1]) for a, b in stretches])
        ranges = sorted([r for i, r in enumerate(ranges) if not any(a <= i <= b for a, b in stretches)] + finer)
    if not ranges:
        return []
    ends = sweep(ranges, smallest_capacity(ranges, shards)[1], shards)
    return [ranges[e - 1][1] if e else -(2**63) for e in ends[:-1]]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: contiguous ranges of the hash, as equal in bytes as whole groups allow."""
    rows = write_table(sizes(docs), "sizes")
    cuts = minimax_cuts(rows, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("place") > c).cast("int")
    placed = rows.select("*", shard.cast("int").alias("shard")).repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")
    placed = write_table(placed.withColumn("at", F.monotonically_increasing_id()).select("*", F.shiftright("at", 33).alias("part")), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = counts.select("shard", "part", "first", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    joined = placed.join(F.broadcast(before), ["shard", "part"])  # a row for each partition and shard in it: partitions + shards rows at most
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first") + F.col("before")).alias("slot"))
