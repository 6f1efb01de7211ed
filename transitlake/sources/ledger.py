"""Incremental ingestion: a ledger of the files that were read, and batches that become visible by one manifest.

Below the ledger's folder:

    files/<batch>/      the files of a batch: path, filename, length, modified, hash
    rows/<batch>/       what was made of their lines
    manifests/<n>.json  the batches that count, in order; the one with the largest n holds

A run writes its batch first and the manifest last. A run that fails leaves files that no manifest names, so readers see
the old state, and the next run does the work again. A file that was read is skipped by path, size and time; where only
its time changed, its hash decides. A changed file's new rows take the place of its old ones.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.sources.logs import log_lines, open_file

FILES = "path string, filename string, length long, modified timestamp, hash string"


def file_hashes(files: DataFrame) -> DataFrame:
    """Adds the SHA-256 of each file's bytes, read as a stream."""
    names = [*files.columns, "hash"]

    def add(batches):
        for batch in batches:
            told = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with open_file(path) as f:
                    while chunk := f.read(1 << 20):
                        digest.update(chunk)
                told.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(add, f"{schema}, hash string")


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        top = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(top):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(top))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def batches(self) -> list[str]:
        """The batches that count, the oldest first."""
        known = self._manifests()
        if not known:
            return []
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{known[-1]:08d}.json", wholetext=True).first()[0])["batches"]

    def _commit(self, before: list[str], batch: str) -> None:
        """Names the batch in a new manifest. Of two runs that began from the same state one fails."""
        number = (self._manifests() or [0])[-1] + 1
        if self.batches() != before:
            raise RuntimeError("another run has committed in the meantime")
        new, last = self._path(f"{self.folder}/manifests/.{batch}"), self._path(f"{self.folder}/manifests/{number:08d}.json")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps({"batches": [*before, batch]}).encode()))
        stream.close()
        if self._fs.exists(last) or not self._fs.rename(new, last):
            raise RuntimeError("another run has committed in the meantime")

    def _read(self, kind: str, batches: list[str], schema=None) -> DataFrame:
        parts = [f"{self.folder}/{kind}/{b}" for b in batches]
        read = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return read.parquet(*parts).withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), f"/{kind}/([^/]+)/", 1))

    def files(self) -> DataFrame:
        """The files that were read, each with its last batch."""
        batches = self.batches()
        if not batches:
            return self.spark.createDataFrame([], f"{FILES}, batch string")
        at = F.array_position(F.array(*map(F.lit, batches)), F.col("_batch"))
        every = self._read("files", batches, FILES).withColumn("_at", at)
        last = every.groupBy("path").agg(F.max_by(F.struct(*(c for c in every.columns if c not in ("path", "_at"))), "_at").alias("f"))
        return last.select("path", "f.filename", "f.length", "f.modified", "f.hash", F.col("f._batch").alias("batch"))

    def pending(self, files: DataFrame) -> DataFrame:
        """Files (path, filename, length, modified) that are new or changed, with their hashes."""
        known = self.files()
        unseen = files.select("path", "filename", "length", "modified").join(known, ["path", "length", "modified"], "left_anti")
        return file_hashes(unseen.select("path", "filename", "length", "modified")).join(known, ["path", "hash"], "left_anti").select("path", "filename", "length", "modified", "hash")

    def ingest(self, files: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame]) -> str | None:
        """Reads what is new among ``files`` and adds make(lines, files): rows with their filename. None if nothing is new."""
        before, batch = self.batches(), uuid.uuid4().hex
        self.pending(files).write.parquet(f"{self.folder}/files/{batch}")
        own = self.spark.read.schema(FILES).parquet(f"{self.folder}/files/{batch}")
        if own.isEmpty():
            return None
        make(log_lines(own), own).write.parquet(f"{self.folder}/rows/{batch}")
        self._commit(before, batch)
        return batch

    def rows(self) -> DataFrame | None:
        """Rows of all batches; of a file that was read again, those of its last batch. None before the first batch."""
        batches = self.batches()
        if not batches:
            return None
        rows = self._read("rows", batches)
        last = self.files().select("filename", F.col("batch").alias("_batch")).distinct()
        return (rows.join(last, ["filename", "_batch"], "left_semi") if len(batches) > 1 else rows).drop("_batch")
