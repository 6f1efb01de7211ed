"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is cut into windows of consecutive words. A window's tokens are its 3-word shingles. A document
holds the window only if it holds all of its shingles, so for exact containment one shingle is a sufficient prefix;
the rarest in the documents gives the fewest candidates. Steps:

1. windows of all items, with their shingles;
2. one pass over the documents counts how often these shingles occur (summed per batch, then per shingle);
3. each window keeps its rarest shingle as prefix;
4. a second pass emits where prefixes occur, with the words around them; a join on the prefix yields candidates,
   positional bounds (the window must start and end inside the document) drop impossible ones, and comparing the words
   themselves verifies containment.

Documents pass a bitmap of fixed size (BITMAP_BITS) before anything is shuffled. Its size is bounded whatever the
benchmark's size; a larger benchmark only lets more rows through to the join.

Defined results: null or wordless texts have no words and no hits. Items without an id or words take no part. Rows that
repeat an item_id are one item with the windows of all. Every document row gives one result row, repeated ids and null
ids included. Without documents the result is empty, without items nothing is hit. Texts may be very long: a text is held
by one task, in time linear in its words. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm._shared import ROW_BITS, covered, hash_windows, hash_words, materialize, probe, text_batches
from transitlake.llm._shared import bitmap as bitmap_of

WINDOW = 10
SHINGLE = 3

_KEEP = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)

_WINDOWS = "item_id string, size int, words array<string>, shingles array<struct<shingle:bigint,at:int>>"
_PREFIXES = "row long, doc_id long, n_words long, found array<struct<shingle:bigint,at:int,before:int,around:array<string>>>"


def words(text: bytes | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z."""
    return text.translate(_KEEP).split() if text else []


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each window of each item."""

    def cut(batches):
        for ids, texts in text_batches(batches, "item_id"):
            rows = []
            for item, text in zip(ids.to_pylist(), texts, strict=True):
                ws = words(text)
                if item is None or not ws:
                    continue
                size = min(window, len(ws))
                k = min(SHINGLE, size)
                shingles = hash_windows(hash_words(ws), k).view(np.int64).tolist()
                ws = [w.decode("utf-8", "replace") for w in ws]
                for i in range(len(ws) - size + 1):
                    inside = [{"shingle": h, "at": j} for j, h in enumerate(shingles[i : i + size - k + 1])]
                    rows.append((item, size, ws[i : i + size], inside))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["item_id", "size", "words", "shingles"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(cut, _WINDOWS)


def _counts(documents: DataFrame, bitmap, sizes: list[int]) -> DataFrame:
    """How often each shingle of the benchmark (and a few that share its bits) occurs in all documents."""

    def count(batches):
        for _, texts in text_batches(batches):
            found = []
            for text in texts:
                hashes = hash_words(words(text))
                for k in sizes:
                    grams = hash_windows(hashes, k)
                    found.append(grams[probe(bitmap.value, grams)])
            shingle, n = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])

    return documents.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _occurrences(documents: DataFrame, bitmap, sizes: list[int], window: int) -> DataFrame:
    """A row for each document, with the places of shingles that may be prefixes and the words around them."""

    def find(batches):
        task, row = TaskContext.get().partitionId() << ROW_BITS, 0
        kind = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.list_(pa.string()))]))
        for ids, texts in text_batches(batches):
            lengths, found = [], []
            for text in texts:
                ws = words(text)
                hashes, own = hash_words(ws), []
                for k in sizes:
                    grams = hash_windows(hashes, k)
                    for i in probe(bitmap.value, grams).tolist():
                        first = max(0, i - window + k)
                        around = [w.decode("utf-8", "replace") for w in ws[first : i + window]]
                        own.append({"shingle": int(grams[i].view(np.int64)), "at": i, "before": i - first, "around": around})
                lengths.append(len(ws))
                found.append(own)
            rows = pa.array(range(task + row, task + row + len(lengths)), pa.int64())
            row += len(lengths)
            yield pa.RecordBatch.from_arrays([rows, ids.cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, kind)], ["row", "doc_id", "n_words", "found"])

    return documents.mapInArrow(find, _PREFIXES)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (array), items_sha256, contaminated: a row for each document row."""
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows = item_windows(benchmark, window)
    windows = materialize(windows.groupBy("size", "words").agg(F.first("shingles").alias("shingles"), F.collect_set("item_id").alias("items")), "item-windows")
    sizes = [r[0] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    inside = windows.select("size", "words", "items", F.explode("shingles").alias("s")).select("size", "words", "items", "s.*")

    bitmap = spark.sparkContext.broadcast(bitmap_of(inside, "shingle"))
    counts = materialize(_counts(documents, bitmap, sizes).join(inside.select("shingle").distinct(), "shingle", "left_semi"), "shingle-counts")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("prefix")
    prefixes = inside.join(counts, "shingle", "left").groupBy("size", "words", "items").agg(rarest)
    prefixes = prefixes.where("prefix.n > 0").select("size", "words", "items", F.col("prefix.shingle").alias("shingle"), F.col("prefix.at").alias("offset"))
    prefixes = materialize(prefixes, "window-prefixes")

    bitmap = spark.sparkContext.broadcast(bitmap_of(prefixes, "shingle"))
    found = materialize(_occurrences(documents, bitmap, sizes, window), "prefix-places")
    places = found.select("row", "n_words", F.explode("found").alias("p")).select("row", "n_words", "p.*")
    start = F.col("at") - F.col("offset")
    candidates = places.join(prefixes, "shingle").where((start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.col("before") >= F.col("offset")))
    verified = candidates.where(F.expr("slice(around, before - offset + 1, size) = words"))
    span = F.struct(start.cast("long").alias("start"), (start + F.col("size")).cast("long").alias("end"))
    hits = verified.groupBy("row").agg(F.collect_set(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    empty = F.array().cast("array<string>")
    result = found.select("row", "doc_id", "n_words").join(hits, "row", "left")
    result = result.select(
        "doc_id",
        "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).alias("size"),
        F.coalesce("items", empty).alias("items"),
    )
    return result.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
    )
