"""Substring de-duplication with fixed-block anchors.

A window is WINDOW consecutive words of one document. A word goes if a window covers it whose words also start in a
document with a smaller id. Anchors are ANCHOR = (WINDOW + 1) / 2 words: wherever a window lies in a reference
document, it holds one whole anchor block of that document, as these start at every multiple of ANCHOR.

1. Documents are dealt into blocks of bounded size and written once, bucketed by block, so that later phases read them
   without a shuffle.
2. Index and probe: a document block gives each distinct hash of ANCHOR words at any place (a probe) once, with marks:
   is it an anchor block of some document here, is it in more than one document here. Hashes travel packed, a few bytes
   each, to buckets; a hash is live if it is an anchor block somewhere and is in two documents. A passage that very many
   documents hold is one entry for each document block.
3. Extension: windows around live hits go out with their 96-bit fingerprint and the smallest id in the block; buckets
   find the smallest id of all and send it back where it is smaller.
4. Each document removes the union of its windows whose smallest id is below its own: these unions are its maximal
   exact repeats.

Anchor hashes only choose what is looked at; windows are told apart by their 96-bit fingerprints.

Defined results: null or wordless texts have no words and keep an empty text. Rows without doc_id take no part and keep
all words. Rows that repeat a doc_id are parts of one document: none is smaller than the other. Texts may be very long;
a document is held by one task. An empty table gives an empty result. Other columns are ignored.

The blocks are written through the session's catalogue, as only bucketed tables keep their layout; it must be writable.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm._shared import forget, hash_texts, hash_windows, materialize, release_shuffles, scratch_root, space_words

WINDOW = 13
#: Bytes of text in a block of documents, and in what a task of a bucket's phase answers for, on average.
BLOCK_CHARS, PART_CHARS = 3_000_000, 64_000_000

_LOW = np.uint64((1 << 40) - 1)
_FORTY = np.uint64(40)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_ENTRY = np.dtype([("hash", "<u8"), ("more", "<u4"), ("doc", "<i8")])
_ANSWER = np.dtype([("hash", "<u8"), ("more", "<u4"), ("doc", "<i8")])

_PACKED = "bucket int, block int, entries binary"


def _table(names: list[str], columns: list[tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({n: pa.array(v, t) for n, (v, t) in zip(names, columns, strict=True)})


def _packed(buckets: np.ndarray, entries: np.ndarray, block: int) -> pa.Table:
    """A row for each bucket with its entries, one after another."""
    order = np.argsort(buckets, kind="stable")
    buckets, entries = buckets[order], entries[order]
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(buckets)] if len(starts) else starts
    rows = [entries[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return _table(["bucket", "block", "entries"], [(buckets[starts].tolist(), pa.int32()), ([block] * len(rows), pa.int32()), (rows, pa.binary())])


def _pack_forty(low: np.ndarray, marks: np.ndarray) -> np.ndarray:
    out = np.empty((len(low), 6), np.uint8)
    out[:, :5] = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5] = marks
    return out


def _unpack_forty(entries: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(entries, np.uint8).reshape(-1, 6)
    low = np.zeros((len(raw), 8), np.uint8)
    low[:, :5] = raw[:, :5]
    return low.view("<u8").ravel(), raw[:, 5]


class Block:
    """Hashes of all words of a block, one document after another, and which document each is of."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_pylist()
        self.number = table.column("block")[0].as_py()
        self.hashes, bounds = hash_texts(table.column("text").combine_chunks())
        self.bounds = bounds[: len(self.ids) + 1]
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))
        self.known = np.array([d is not None for d in self.ids], bool)

    def places(self, size: int) -> np.ndarray:
        """Where runs of ``size`` words of one document with an id begin."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero((self.doc[:n] == self.doc[size - 1 :]) & self.known[self.doc[:n]])

    def id_of(self, at: np.ndarray) -> np.ndarray:
        return np.array([d or 0 for d in self.ids], np.int64)[self.doc[at]]


def fingerprints(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each window's fingerprint."""
    return hash_windows(hashes, window), (hash_windows(hashes ^ _OTHER, window) >> np.uint64(32)).astype(np.uint32)


def grouped(hash_: np.ndarray, more: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by fingerprint, then doc, and which of the ordered rows begin a fingerprint."""
    hash_, more, doc = (np.ascontiguousarray(x) for x in (hash_, more, doc))
    order = np.argsort(hash_)
    sorted_ = hash_[order]
    same = np.r_[False, sorted_[1:] == sorted_[:-1]] if len(order) else np.empty(0, bool)
    # Only where hashes meet does the rest of the order matter; that is a small part as a rule.
    tied = np.flatnonzero(same | np.r_[same[1:], False][: len(same)])
    own = order[tied]
    order[tied] = own[np.lexsort((doc[own], more[own], hash_[own]))]
    more = more[order]
    return order, ~same | np.r_[False, more[1:] != more[:-1]][: len(same)]


def _anchors_of_block(table: pa.Table, n_buckets: int, anchor: int) -> pa.Table:
    block = Block(table)
    at = block.places(anchor)
    if not len(at):
        return _packed(np.empty(0, np.int32), np.empty((0, 6), np.uint8), block.number)
    grams = hash_windows(block.hashes, anchor)[at]
    order = np.argsort(grams)
    grams, docs = grams[order], block.doc[at][order]
    fixed = ((at - block.bounds[block.doc[at]]) % anchor == 0)[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
    marks = np.logical_or.reduceat(fixed, starts).astype(np.uint8) | (several.astype(np.uint8) << 1)
    grams = grams[starts]
    return _packed(((grams >> _FORTY) % np.uint64(n_buckets)).astype(np.int32), _pack_forty(grams & _LOW, marks), block.number)


def _by_bucket(batches) -> dict[int, list[tuple[int, bytes]]]:
    """What a task has, by bucket: a share of all hashes that shrinks as partitions are added."""
    by: dict[int, list] = {}
    for batch in batches:
        for bucket, block, entries in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "entries")), strict=True):
            by.setdefault(bucket, []).append((block, entries))
    return by


def _live(batches):
    """Sends back to each block those of its hashes that are live."""
    by = _by_bucket(batches)
    for bucket in list(by):
        rows = by.pop(bucket)
        parts = [_unpack_forty(x) for _, x in rows]
        low, marks = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(low)
        low, marks = low[order], marks[order]
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        times = np.diff(np.r_[starts, len(low)])
        seen = np.bitwise_or.reduceat(marks, starts)
        live = low[starts][((seen & 1) > 0) & ((times > 1) | ((seen & 2) > 0))]
        if not len(live):
            continue
        for (block, _), (own, _) in zip(rows, parts, strict=True):
            mine = own[live[np.minimum(np.searchsorted(live, own), len(live) - 1)] == own]
            if len(mine):
                keys = mine | (np.uint64(bucket) << _FORTY)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([keys.astype("<u8").tobytes()], pa.binary())], ["bucket", "block", "entries"])


def _joined(table: pa.Table, dtype) -> np.ndarray:
    rows = table.column("entries").to_pylist()
    return np.frombuffer(b"".join(rows), dtype)


def _windows_of_block(documents: pa.Table, live: pa.Table, n_buckets: int, window: int, anchor: int) -> pa.Table:
    names = ["bucket", "block", "entries"]
    nothing = _table(names, [([], pa.int32()), ([], pa.int32()), ([], pa.binary())])
    if not live.num_rows:
        return nothing
    keys = np.sort(_joined(live, "<u8"))
    block = Block(documents)
    at = block.places(window)
    if not len(at):
        return nothing
    grams = hash_windows(block.hashes, anchor)
    own = (grams & _LOW) | (((grams >> _FORTY) % np.uint64(n_buckets)) << _FORTY)
    hit = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
    sums = np.r_[0, np.cumsum(hit)]
    # A window lies in one document, so its anchors do, too.
    at = at[sums[at + anchor] > sums[at]]
    if not len(at):
        return nothing
    hash_, more = fingerprints(block.hashes, window)
    rows = np.empty(len(at), _ENTRY)
    rows["hash"], rows["more"], rows["doc"] = hash_[at], more[at], block.id_of(at)
    order, starts = grouped(rows["hash"], rows["more"], rows["doc"])
    rows = rows[order[starts]]
    return _packed((rows["hash"] % np.uint64(n_buckets)).astype(np.int32), rows, block.number)


def _smallest(batches):
    """Sends back to each block the smallest id of a window where another block has a smaller one."""
    by = _by_bucket(batches)
    for bucket in list(by):
        rows = by.pop(bucket)
        parts = [np.frombuffer(x, _ENTRY) for _, x in rows]
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        every = np.concatenate(parts)
        order, starts = grouped(every["hash"], every["more"], every["doc"])
        every, owner = every[order], owner[order]
        least = every["doc"][np.flatnonzero(starts)][np.cumsum(starts) - 1]
        beaten = np.flatnonzero(least < every["doc"])
        beaten = beaten[np.argsort(owner[beaten], kind="stable")]
        owners, first = np.unique(owner[beaten], return_index=True)
        for i, a, b in zip(owners.tolist(), first.tolist(), [*first[1:].tolist(), len(beaten)], strict=False):
            own = beaten[a:b]
            out = np.empty(len(own), _ANSWER)
            out["hash"], out["more"], out["doc"] = every["hash"][own], every["more"][own], least[own]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([rows[i][0]], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["bucket", "block", "entries"])


def _kept_of_block(documents: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    block = Block(documents)
    at = block.places(window)
    whole = hash_windows(block.hashes, window)
    told = _joined(answers, _ANSWER) if answers.num_rows else np.empty(0, _ANSWER)
    keys = np.concatenate([whole[at], told["hash"]])
    # Windows whose first 64 bits meet no other's stay; the whole fingerprint is taken of the others alone.
    order = np.argsort(keys)
    same = np.r_[False, keys[order][1:] == keys[order][:-1]] if len(keys) else np.empty(0, bool)
    met = np.zeros(len(keys), bool)
    met[order[same | np.r_[same[1:], False][: len(same)]]] = True
    met = np.flatnonzero(met)
    more = np.r_[fingerprints(block.hashes, window)[1][at], told["more"]] if len(met) else np.empty(0, np.uint32)
    ids = np.r_[block.id_of(at), told["doc"]][met] if len(met) else np.empty(0, np.int64)
    order, starts = grouped(keys[met], more[met], ids)
    least = np.empty(len(met), np.int64)
    least[order] = ids[order][np.flatnonzero(starts)][np.cumsum(starts) - 1] if len(met) else 0
    gone = at[met[(least < ids) & (met < len(at))]]
    edges = np.zeros(len(block.hashes) + 1, np.int64)
    np.add.at(edges, gone, 1)
    np.add.at(edges, gone + window, -1)
    covered = np.cumsum(edges)[: len(block.hashes)] > 0
    lost = np.r_[0, np.cumsum(covered)][block.bounds]
    rows, texts = [], documents.column("text").cast(pa.large_binary()).to_pylist()
    for doc, text, a, b, n in zip(block.ids, texts, block.bounds[:-1].tolist(), block.bounds[1:].tolist(), np.diff(lost).tolist(), strict=True):
        ws, spans = space_words(text), []
        if n:
            own = covered[a:b]
            turns = np.flatnonzero(np.diff(np.r_[False, own, False])).tolist()
            spans = [{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2], strict=True)]
            ws = [w for w, c in zip(ws, own.tolist(), strict=True) if not c]
        rows.append((doc, b - a, n, spans, b" ".join(ws).decode("utf-8", "replace")))
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    return _table(["doc_id", "n_words", "n_removed", "removed", "kept_text"], [(list(c), t) for c, t in zip(columns, kinds, strict=True)])


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, removed (spans of words), kept_text: a row for each document row."""
    spark = documents.sparkSession
    anchor = (window + 1) // 2
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / PART_CHARS))
    n_blocks = max(2 * parts, math.ceil(chars / BLOCK_CHARS))
    name = f"blocks_{uuid.uuid4().hex}"
    # By row, so that rows that repeat don't meet in one block.
    dealt = documents.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")).repartition(parts, "block")
    dealt.write.format("parquet").option("compression", "zstd").option("path", f"{scratch_root(spark)}/{name}").bucketBy(parts, "block").saveAsTable(name)
    release_shuffles(spark)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry; the files stay for what reads them

    def anchors(table):
        return _anchors_of_block(table, parts, anchor)

    def windows(docs, live):
        return _windows_of_block(docs, live, parts, window, anchor)

    def kept(docs, answers):
        return _kept_of_block(docs, answers, window)

    live = materialize(blocks.groupBy("block").applyInArrow(anchors, _PACKED).repartition(parts, "bucket").mapInArrow(_live, _PACKED), "live-anchors")
    release_shuffles(spark)
    sent = blocks.groupBy("block").cogroup(live.groupBy("block")).applyInArrow(windows, _PACKED)
    answers = materialize(sent.repartition(parts, "bucket").mapInArrow(_smallest, _PACKED), "smallest-ids")
    release_shuffles(spark)
    forget(live)
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept_text string"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(kept, schema)
