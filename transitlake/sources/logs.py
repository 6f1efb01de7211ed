"""Zipped log files as lines: a Spark data source that inflates members as streams."""

from __future__ import annotations

import errno
import fnmatch
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = "path string, filename string, line_num long, line string"
FORMAT = "zipped_logs"
GLOB = "*.txt.zip"
#: Zipped bytes that a task reads on average; what a member is inflated by; lines of a batch.
PART_BYTES, CHUNK_BYTES, BATCH_LINES = 64 << 20, 1 << 20, 50_000

#: What a damaged or foreign file raises. Failing storage raises others, and its task is tried again.
_DAMAGED = (zipfile.BadZipFile, KeyError, zlib.error, EOFError, struct.error, NotImplementedError, RuntimeError)


def member_of(path: str) -> str:
    """The text file's name that a log file's name promises."""
    return re.sub(r"\.zip$", "", path.rsplit("/", 1)[-1])


def open_file(path: str):
    """A file that can be read and sought, on any file system that pyarrow knows."""
    if "://" not in path:
        return open(re.sub("^file:", "", path), "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _inflated(archive: zipfile.ZipFile, name: str) -> Iterator[bytes]:
    with archive.open(name) as member:
        while chunk := member.read(CHUNK_BYTES):
            yield chunk


def _lines(chunks: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Lines parted by line feeds, some at a time; what follows the last line feed counts if it isn't empty."""
    rest = b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        for at in range(0, len(whole), BATCH_LINES):
            yield whole[at : at + BATCH_LINES]
    if rest:
        yield [rest]


def read_file(path: str) -> Iterator[pa.RecordBatch]:
    """Numbered lines of one file in batches; none if it is damaged or has no member of the promised name.

    A member is inflated twice, first to see whether it is whole, so that a damaged file gives no line at all. At any
    time a chunk of it is in memory, or its longest line if that is longer.
    """
    name, n = member_of(path), 0
    try:
        with open_file(path) as f, zipfile.ZipFile(f) as archive:
            for _ in _inflated(archive, name):
                pass
            for lines in _lines(_inflated(archive, name)):
                text = [x.rstrip(b"\r").decode("latin-1") for x in lines]
                columns = [pa.array([path] * len(text)), pa.array([name] * len(text)), pa.array(range(n + 1, n + 1 + len(text)), pa.int64()), pa.array(text, pa.string())]
                n += len(text)
                yield pa.RecordBatch.from_arrays(columns, ["path", "filename", "line_num", "line"])
    except _DAMAGED:
        return
    except OSError as e:
        if e.errno != errno.EINVAL:  # an offset outside of the file
            raise


def pack(sizes: Sequence[tuple[str, int]], bound: int) -> list[list[str]]:
    """Paths dealt to parts of about ``bound`` bytes: large files first, each to the part that has least."""
    parts = max(1, -(-sum(n for _, n in sizes) // bound))
    bins: list[tuple[int, int, list[str]]] = [(0, i, []) for i in range(min(parts, len(sizes)))]
    import heapq

    for path, n in sorted(sizes, key=lambda s: (-s[1], s[0])):
        total, i, own = heapq.heappop(bins)
        own.append(path)
        heapq.heappush(bins, (total + n, i, own))
    return [own for _, _, own in sorted(bins, key=lambda b: b[1]) if own]


def list_files(folder: str, glob: str = GLOB) -> list[tuple[str, int]]:
    """(path, bytes) of files below a folder whose names match, by path."""
    if "://" not in folder:
        top = re.sub("^file:", "", folder)
        found = [os.path.join(d, n) for d, _, names in os.walk(top) for n in names if fnmatch.fnmatchcase(n, glob)]
        return sorted((p, os.path.getsize(p)) for p in found)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(folder)
    scheme = folder.split("://")[0]
    infos = system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((f"{scheme}://{i.path}", i.size) for i in infos if i.is_file and fnmatch.fnmatchcase(i.base_name, glob))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.folders = options["path"].split(options.get("separator", ","))
        self.glob, self.bound = options.get("glob", GLOB), int(options.get("partBytes", PART_BYTES))
        self.most = int(options["most"]) if "most" in options else None

    def partitions(self) -> list[Files]:
        found = sorted(x for folder in self.folders for x in list_files(folder, self.glob))[: self.most]
        return [Files(paths) for paths in pack(found, self.bound)] if found else [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from read_file(path)


class LogSource(DataSource):
    """spark.read.format(FORMAT).option("path", folders): lines of all log files below, packed into tasks by size.

    Options: path (folders parted by commas), glob, most (the first files by path), partBytes.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def read_logs(spark: SparkSession, folders: str | Sequence[str], glob: str = GLOB, most: int | None = None) -> DataFrame:
    """path, filename, line_num, line of log files below the folders."""
    spark.dataSource.register(LogSource)
    told = {"path": folders if isinstance(folders, str) else ",".join(folders), "glob": glob} | ({"most": str(most)} if most else {})
    return spark.read.format(FORMAT).options(**told).load()


def log_files(spark: SparkSession, paths: str | Sequence[str], glob: str = GLOB, most: int | None = None) -> DataFrame:
    """path, filename (the text file's name), length, modified of log files below one or more folders; the first ``most`` by path."""
    if not isinstance(paths, (str, list, tuple)):
        raise TypeError("paths is a folder or a list of folders")
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load([paths] if isinstance(paths, str) else list(paths))
    # The contents are not read.
    named = found.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.zip)?$", 1).alias("filename"), "length", F.col("modificationTime").alias("modified"))
    return named.orderBy("path").limit(most) if most else named


def log_lines(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Numbered lines of each listed file, parted by line feeds only. Files that can't be read have none; join the list."""
    total = files.agg(F.sum("length")).first()[0] or 0

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from read_file(path)

    return files.select("path").repartition(max(1, -(-total // part_bytes)), "path").mapInArrow(read, LINES)
