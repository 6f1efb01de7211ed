"""Helpers that several corpus operators use."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows carry ``partition << ROW_BITS | index`` as their own number once a table is written.
ROW_BITS = 33

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, or a temporary one where it is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='transitlake-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder, by partition where told, and reads it back: lineage is cut, and a lost executor
    costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished phases: it does so when their handles are collected."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


BITMAP_BITS = 24


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit for the low bits of each value of a long column: 2 ** BITMAP_BITS bits however many values there are."""
    low = F.col(column).bitwiseAND((1 << BITMAP_BITS) - 1)
    cells = hashes.select(F.shiftright(low, 6).alias("cell"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint64)


def probe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bit is set."""
    low = hashes & np.uint64((1 << BITMAP_BITS) - 1)
    return np.flatnonzero((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a fixed number of words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def hash_texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """What hash_words(space_words(text)) gives for each text of an Arrow column, one after another, and where each
    text's begin (one more for the end). Each distinct word is hashed once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    named = pc.dictionary_encode(split.flatten())
    at, words = named.indices.to_numpy(), named.dictionary.cast(pa.large_binary()).to_pylist()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    real = (pc.binary_length(named.dictionary).to_numpy(zero_copy_only=False) > 0)[at]  # not what stands before or behind all words
    return each[at[real]], np.r_[0, np.cumsum(real)][split.offsets.to_numpy()]


def hash_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words, in order; empty if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = hashes[:n] * _MULTIPLIER
    for i in range(1, size):
        mixed ^= mixed >> _SHIFT
        mixed += hashes[i : i + n]
        mixed *= _MULTIPLIER
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MULTIPLIER
    mixed ^= mixed >> _SHIFT
    return mixed


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what bytes.split() takes, as its white space is exactly these six."""
    return text.split() if text else []


def lower_ascii(text: bytes | None) -> bytes:
    return text.lower() if text else b""


def gather(values: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the entries ``at``, one after another, and their number; entry i has counts[i] of ``values``."""
    n = counts[at]
    ends = np.cumsum(n)
    shift = (np.cumsum(counts) - counts)[at] - (ends - n)
    return values[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0)], n


def valid_text(column):
    """An Arrow column of texts as valid UTF-8, null as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()], pa.large_string())
    return column


#: Bytes of text that are worked on at once, one text at least.
SLICE_BYTES = 6_000_000


def text_slices(column, size: int = SLICE_BYTES):
    """(first row, texts as valid_text gives them) of consecutive parts of a column, of about ``size`` bytes each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = valid_text(column)
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield first, column.slice(first, last - first)
        first = last
    # Workers live on, and would keep what the batch took.
    pa.default_memory_pool().release_unused()


def covered(ranges):
    """Column: positions covered by an array of (start, end) structs, counted once each."""
    first = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["end"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["end"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(ranges), first, step, lambda a: a["n"])


def text_batches(batches, id_column: str = "doc_id", text_column: str = "text"):
    """Each Arrow batch with its ids (an Arrow array) and texts (a list of bytes or None)."""
    import pyarrow as pa

    for batch in batches:
        yield batch.column(id_column), batch.column(text_column).cast(pa.large_binary()).to_pylist()
