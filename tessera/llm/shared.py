"""Helpers that the corpus operators share: text access, shared storage, chunked batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker looks at together; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session a folder of our own where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: driver and executors have no folder in common")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"


#: Whether the shuffle files of an execution go when it ends, instead of with the driver's garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, label: str, free: bool = False, **options: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: the lineage ends there, and any executor can reread it. free: the shuffle files of this step go at once."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(CLEANUP)
        elif free:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables of write_table that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch in this session, unless that is set already: long texts would make batches of any size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), whatever else the input has."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Rows of 64 bits in a filter: by the number of keys, and at most so many (64 MB).
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 22


def filter_of(keys: DataFrame, name: str) -> DataFrame:
    """A bit set of the hashed keys, as (row, bits) and the column `rows`, their number: about 16 bits a key, but never beyond MOST_ROWS rows, so it may be broadcast."""
    rows, h = min(MOST_ROWS, max(LEAST_ROWS, 1 << (keys.count() // 4).bit_length())), F.xxhash64(name)
    bits = keys.select(F.pmod(h, F.lit(rows)).alias("filter_row"), F.shiftright(h, 58).cast("int").alias("at")).groupBy("filter_row").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("filter_bits"))
    return write_table(bits, "filter").withMetadata("filter_row", {"rows": rows})


def marked(df: DataFrame, name: str, bits: DataFrame, may: str) -> DataFrame:
    """df with the column `may`: false only where the key of that name is none of the filter's. df must not have columns filter_row and filter_bits."""
    h, rows = F.xxhash64(name), bits.schema["filter_row"].metadata["rows"]
    set_ = F.expr(f"(shiftright(filter_bits, cast(shiftright(xxhash64(`{name}`), 58) & 63 as int)) & 1) = 1")
    return df.join(F.broadcast(bits), F.pmod(h, F.lit(rows)) == F.col("filter_row"), "left").withColumn(may, F.coalesce(set_, F.lit(False))).drop("filter_row", "filter_bits")


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def inner(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or a field of a struct column as column.field."""
    name, *fields = path.split(".")
    return pc.struct_field(batch.column(name), fields) if fields else batch.column(name)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of one slice have about limit bytes; a slice has at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(inner(batch, column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word bytes to a signed 64-bit hash, remembered; it forgets everything when it has grown too large."""

    def __init__(self, most: int = 250_000) -> None:
        super().__init__()
        import xxhash

        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(texts: list[bytes], lower: bool = True) -> tuple[list[bytes], np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in a row, and how many each has. bytes.lower and bytes.split see ASCII only."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = (text.lower() if lower else text).split()
        counts[i] = len(own)
        words += own
    return words, counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums, with the total at the end."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
