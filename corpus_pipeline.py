"""A training-data pipeline of corpus operators: each stage works on all that its predecessor kept.

Toxic documents go; of each group of near duplicates one stays; documents with benchmark passages go; personal data is
replaced by its kind in brackets; the rest is packed into sequences. Rows without doc_id pass every filter, as no
decision names them. All stages but the last return the columns of documents.

Defined results: null and empty texts are clean, hold no personal data and are packed as one closing id. Rows that repeat
a doc_id share the decisions of near-dedup and decontamination; toxicity judges each row by its text. Columns beyond those
of documents are kept by all stages but packing. A stage over an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm._shared import scratch_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not among ids."""
    gone = ids.select(F.col("doc_id").alias("_gone")).where("_gone is not null").distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold."""
    from transitlake.llm.toxicity import THRESHOLD, score, train

    scorer = train(docs, _table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text"), scorer, spark) < THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component."""
    from transitlake.llm.neardup import near_duplicates

    return _without(docs, near_duplicates(docs).where(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    from transitlake.llm.decontaminate import decontaminate

    return _without(docs, decontaminate(docs, _table(spark, sf_dir, "benchmark")).where("contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts."""
    from transitlake.llm import pii as P
    from transitlake.llm.spans import let

    text = F.coalesce(F.col("text"), F.lit(""))
    model = P.fit(docs.select(P.candidates(text).alias("candidates")))
    masked = let(P.accepted(P.candidates(text), model), lambda spans: P.redact(F.col("text"), spans))
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), masked))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    import public_tokenizers

    from transitlake.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: SQL can express neither the learnt stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
