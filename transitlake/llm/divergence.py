"""Audit of sources: how far the sources of a language diverge from each other, and by which terms from the language.

1. Terms. Each document is a list of terms, written by language. Where a language may keep more than MODEL_TERMS terms (it
   has more than MIN_DF times as many occurrences, and more distinct terms by a sketch), its lists are dealt to shards by
   the terms' hash, so that no vocabulary outgrows that bound. A term's documents all meet in one shard, so document
   frequencies stay exact.
2. Vectors. A CountVectorizer for each language (and shard), with minDF and the largest integer as vocabSize, fits its
   vocabulary and turns the documents into exact sparse count vectors.
3. Group sums. Vectors are summed by source without being made dense: a task adds up what its batches hold by source and
   index, then these partial sums meet. The vocabulary, read from the written model, gives indices their terms again.
4. Pairs, sparsely. f(p, q) over all kept terms is what it is where both counts are 0, times the number of terms, plus
   corrections for terms that only one of both holds, which depend on the count alone and so are taken by distinct
   count, plus corrections for terms that both hold. Only the last are joined by term.

All arithmetic is on integers; products that may pass 64 bits are decimals.

Defined results: null text, lang and source are ''. Documents without terms make up a group like others; with fewer than
min_df documents a language keeps no terms. A language with one source has no pairs. Rows that repeat a doc_id are
documents of their own; ids are never read. Ties rank by the item's UTF-8 bytes. Texts may be very long: a text's terms
are one row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.llm._shared import materialize, scratch_root, text_slices

MIN_DF = 10
#: The largest integer: no vocabulary is cut.
VOCABULARY = 2**31 - 1
#: Terms that one model may keep; languages with more are dealt to more models.
MODEL_TERMS = 8_000_000
#: Names of languages that are broadcast; more are joined by a shuffle.
BROADCAST_LANGS = 10_000
SCALE, TOP = 1_000_000_000, 10

#: Each byte of UTF-8 as a part of a term (A-Z lower-cased) or as a blank.
_BYTES = np.full(256, 0x20, np.uint8)
for _low, _high, _shift in ((0x41, 0x5B, 0x20), (0x61, 0x7B, 0), (0x80, 0x100, 0)):
    _BYTES[_low:_high] = np.arange(_low, _high) + _shift


def split_terms(texts: pa.Array) -> pa.Array:
    """Lists of the terms [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of texts (large strings without nulls), in order; [''] where there are none."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _BYTES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))
    return pc.ascii_split_whitespace(pc.ascii_trim(plain, " "))


def term_lists(documents: DataFrame) -> DataFrame:
    """model, source, terms, n_terms of each document (model, source, text) that has terms."""

    def split(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                lists = split_terms(texts)
                found = pc.greater(pc.binary_length(pc.list_element(lists, 0)), 0)
                own = [batch.column(c).slice(first, len(texts)) for c in ("model", "source")]
                columns = (*own, lists.cast(pa.list_(pa.string())), pc.list_value_length(lists).cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([x.filter(found) for x in columns], ["model", "source", "terms", "n_terms"])

    return documents.select("model", "source", "text").mapInArrow(split, "model int, source string, terms array<string>, n_terms long")


def group_sums(vectors: DataFrame) -> DataFrame:
    """source, index, n: sums of sparse vectors (source, vector) by source."""

    def add(batches):
        for batch in batches:
            vector = batch.column("vector").combine_chunks() if isinstance(batch.column("vector"), pa.ChunkedArray) else batch.column("vector")
            indices, values = vector.field("indices"), vector.field("values")
            lengths = np.diff(indices.offsets.to_numpy())
            if not len(lengths) or not lengths.sum():
                continue
            named = batch.column("source").dictionary_encode()
            source = np.repeat(named.indices.to_numpy().astype(np.int64), lengths)
            first, last = indices.offsets[0].as_py(), indices.offsets[-1].as_py()
            key = source << 32 | indices.values.to_numpy()[first:last].astype(np.int64)
            keys, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, values.values.to_numpy()[first:last], len(keys)).astype(np.int64)  # exact: whole numbers below 2 ** 53
            yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(keys >> 32)).cast(pa.string()), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["source", "index", "n"])

    return vectors.mapInArrow(add, "source string, index int, n long").groupBy("source", "index").agg(F.sum("n").alias("n"))


def group_counts(documents: DataFrame, min_df: int = MIN_DF, model_terms: int = MODEL_TERMS) -> DataFrame:
    """lang, source, term, n: occurrences of each kept term in each group that holds it; written to the shared folder."""
    spark, folder = documents.sparkSession, f"{scratch_root(documents.sparkSession)}/divergence-{uuid.uuid4().hex}"
    told = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")
    schema = "lang string, source string, term string, n long"
    # Languages with enough documents for any term to be kept, by number, as their names may be any text.
    enough = told.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_df)
    langs = sorted(r["lang"] for r in enough.collect())
    if not langs:
        return spark.createDataFrame([], schema)
    known = spark.createDataFrame(list(zip(langs, range(len(langs)), strict=True)), "lang string, model int")
    named = told.join(F.broadcast(known) if len(langs) <= BROADCAST_LANGS else known, "lang")
    term_lists(named).write.partitionBy("model").parquet(f"{folder}/terms")
    every = spark.read.schema("source string, terms array<string>, n_terms long, model int").parquet(f"{folder}/terms")
    spark.createDataFrame([], schema).write.parquet(f"{folder}/counts")
    # A kept term occurs min_df times at least. Only where that bound is too large, distinct terms are counted.
    most = {r["model"]: r["n"] // max(1, min_df) for r in every.groupBy("model").agg(F.sum("n_terms").alias("n")).collect()}
    large = [i for i, n in most.items() if n > model_terms]
    if large:
        each = every.where(F.col("model").isin(large)).select("model", F.explode("terms").alias("term"))
        most |= {r["model"]: r["n"] for r in each.groupBy("model").agg(F.approx_count_distinct("term").alias("n")).collect()}
    for i, shards in sorted((i, max(1, math.ceil(n / model_terms))) for i, n in most.items()):
        path = f"{folder}/terms/model={i}"
        if shards > 1:
            # Written once more, so that each model reads its own terms only.
            at = lambda t: F.pmod(F.xxhash64(t), F.lit(shards)).cast("int")  # noqa: E731, B023
            parts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(k.alias("shard"), F.filter("terms", lambda t: at(t) == k).alias("terms")))  # noqa: B023
            dealt = every.where(F.col("model") == i).select("source", F.explode(parts).alias("p")).select("source", "p.*").where(F.size("terms") > 0)
            path = f"{folder}/shards-{i}"
            dealt.write.partitionBy("shard").parquet(path)
        for k in range(shards):
            own = spark.read.schema("source string, terms array<string>, shard int").parquet(path)
            own = (own.where(F.col("shard") == k) if shards > 1 else own).select("source", "terms")
            try:
                model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=min_df, vocabSize=VOCABULARY).fit(own)
            except IllegalArgumentException as e:
                if "vocabulary size" not in str(e):
                    raise
                continue  # no term is in so many documents
            model.write().save(f"{folder}/models/{i}-{k}")
            named = spark.read.parquet(f"{folder}/models/{i}-{k}/data").select(F.posexplode("vocabulary").alias("index", "term"))
            sums = group_sums(model.transform(own).select("source", "vector"))
            sums.join(named, "index").select(F.lit(langs[i]).alias("lang"), "source", "term", "n").write.mode("append").parquet(f"{folder}/counts")
    return spark.read.schema(schema).parquet(f"{folder}/counts")


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size))"""
    wide = lambda c: c.cast("decimal(19,0)")
    scale = F.lit(SCALE).cast("long")
    exact = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 2), wide(total) + 2 * wide(size))
    # Products below 2 ** 63 need no decimals.
    return F.lit(1).cast("long") + F.when(count < 9_000_000_000, F.call_function("div", scale * (count + 2), total + 2 * size)).otherwise(exact)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank from group_counts and the groups (lang, source) that occur."""
    langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = materialize(langs, "language-counts")
    sizes = langs.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("of_group"))
    zero = F.lit(0).cast("long")
    known = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    known = known.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("of_group", "v", "total")))
    known = materialize(known.withColumn("none", F.when(F.col("v") > 0, _share(zero, F.col("of_group"), F.col("v")))), "divergence-groups")
    shares = counts.join(known, ["lang", "source"]).select("lang", "source", "term", "none", _share(F.col("n"), F.col("of_group"), F.col("v")).alias("p"))
    shares = materialize(shares, "divergence-shares")

    # Terms: against the language.
    q = langs.join(sizes, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    by_term = shares.join(q, ["lang", "term"]).where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = by_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Pairs: the result has a row for each two sources of a language, so they are joined by language.
    side = lambda x: known.select("lang", F.col("source").alias(x), F.col("none").alias(f"none_{x}"), F.col("v").alias(f"v_{x}"))
    pairs = side("a").join(side("b"), "lang").where("a != b")
    # Of a's terms, by distinct count: against b's share of an absent term instead of both being absent.
    held = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count(F.lit(1)).alias("k"))
    single = held.join(pairs, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("k") * (_apart(F.col("p"), F.col("none_b")) - _apart(F.col("none_a"), F.col("none_b")))).alias("value"))
    # Of terms that both hold: what the two single corrections get wrong.
    one = lambda x: shares.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p_{x}"), F.col("none").alias(f"none_{x}"))
    p_a, p_b, none_a, none_b = (F.col(c) for c in ("p_a", "p_b", "none_a", "none_b"))
    fixed = _apart(p_a, p_b) - _apart(p_a, none_b) - _apart(none_a, p_b) + _apart(none_a, none_b)
    shared = one("a").join(one("b"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(fixed).alias("value"))
    swapped = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    absent = pairs.select("lang", "a", "b", (F.col("v_a") * F.coalesce(_apart(F.col("none_a"), F.col("none_b")), zero)).alias("value"))
    parts = absent.unionByName(single).unionByName(swapped(single)).unionByName(shared).unionByName(swapped(shared))
    by_pair = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    by_pair = by_pair.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    by_pair = by_pair.withColumn("rank", F.row_number().over(order))
    return by_pair.unionByName(by_term)


def audit_sources(documents: DataFrame, min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of all groups of documents."""
    groups = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    return divergence(group_counts(documents, min_df), groups, top)
