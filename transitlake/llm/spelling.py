"""Spelling variants: words that differ by one code point, and the common form that each rare one belongs to.

1. Counting. Runs of letters of whole texts, lower-cased in A-Z, are counted where they stand: a task's slice of texts
   gives each distinct word once. A run whose checksum with its document's id is divisible by SLIP loses one code point,
   which plants misspellings at a known rate.
2. Candidates by asymmetric chunks. Of two words, the shorter (or either of equal ones) is cut into two disjoint chunks,
   its halves; one edit leaves one of them whole. A half is shared by very many words, so the other half is cut again in
   the same way, and again one of its parts is whole: a word of m letters gives four keys, each all of it but a quarter,
   with m and the quarter's number. The longer word gives, for partners of its own length and one less, the grams that
   stand at the same places: those before the gap where they are, those behind it shifted by the difference, at most
   one. Equal keys meet.
3. Candidates are verified as exactly one edit. A pair that several keys bring together counts once.
4. Each word takes its near word of the largest count as its form, if that is RATIO times its own; roots follow forms to
   the end by pointer doubling. A form's count grows by RATIO at each step, so the number of rounds is bounded by the
   logarithm of the logarithm of the largest count.

Defined results: null and wordless texts have no words. A row without doc_id counts with an empty id in its checksums.
Rows that repeat a doc_id or a text each count. Ties of counts go to the first word in code-point order. Texts may be
very long: a text is held by one task, its words are counted in slices of RUNS runs. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm._shared import forget, materialize, text_slices

SLIP = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Runs that are counted before their words are sent on.
RUNS = 2_000_000
QUARTERS = 4

_RUN = re.compile("[a-zÀ-ÿ]+")


def slipped(word: str, checksum: int) -> str:
    """The word less one code point where its checksum says so."""
    if checksum % SLIP:
        return word
    at = checksum % len(word)
    return word[:at] + word[at + 1 :]


def _counted(ids: list, texts: list[bytes], min_length: int):
    """(word, n) of slices of the texts' runs."""
    total, runs = Counter(), 0
    for doc, text in zip(ids, texts, strict=True):
        begun = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
        every = (m[0] for m in _RUN.finditer(text.lower().decode("utf-8", "replace")))
        while part := Counter(itertools.islice(every, RUNS)):
            for word, n in part.items():
                if len(word) >= min_length:
                    word = slipped(word, zlib.crc32(word.encode(), begun))
                    if len(word) >= min_length:
                        total[word] += n
            runs += sum(part.values())
            if runs >= RUNS:
                yield total
                total, runs = Counter(), 0
    yield total


def word_counts(documents: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""

    def count(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                ids = batch.column("doc_id").slice(first, len(texts)).to_pylist()
                for total in _counted(ids, texts.cast(pa.large_binary()).to_pylist(), min_length):
                    if total:
                        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = documents.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _bounds(length: Column) -> list[Column]:
    """Where the quarters of a word of this length begin, and its end: its halves, cut in halves."""
    half = F.floor(length / 2).cast("int")
    return [F.lit(0), F.floor(half / 2).cast("int"), half, (half + F.floor((length - half) / 2)).cast("int"), length]


def _keys(word: Column, length: Column, shift: int) -> list[Column]:
    """Keys by quarter for partners of ``length`` letters, the word itself having ``shift`` more."""
    at = _bounds(length)
    rest = lambda i: F.concat(F.substring(word, F.lit(1), at[i]), F.substring(word, at[i + 1] + shift + 1, length))
    return [F.struct(length.alias("m"), F.lit(i).alias("quarter"), rest(i).alias("rest")) for i in range(QUARTERS)]


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """a, b, n_a, n_b: each two words (word, n) that are one edit apart, once."""
    m = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(*_keys(F.col("word"), m, 0))).alias("key"))
    shorter = F.when(m > min_length, F.array(*_keys(F.col("word"), m - 1, 1))).otherwise(F.array().cast("array<struct<m:int,quarter:int,rest:string>>"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.concat(F.array(*_keys(F.col("word"), m, 0)), shorter)).alias("key"))
    parts = lambda df, *more: df.select(*more, "key.m", "key.quarter", "key.rest")
    met = parts(chunks, "a", "n_a").join(parts(grams, "b", "n_b"), ["m", "quarter", "rest"])
    # Two words of one length meet from both sides.
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    near = met.where(once & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "b", "n_a", "n_b").distinct()


def spelling_variants(documents: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word."""
    words = materialize(word_counts(documents, min_length, min_count), "words")
    pairs = near_pairs(words, min_length)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("k")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("k")))
    ends = pairs.select(F.explode(both).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("k")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    known = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"), "spelling-forms")
    most = known.agg(F.max("form_n")).first()[0]
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    steps = max(1, math.floor(math.log(max(most or 1, min_count) / min_count, ratio)) + 1)  # of the longest chain
    for _ in range(math.ceil(math.log2(steps))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        doubled = materialize(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        roots = doubled
    forget(words)
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
