"""Packing documents into sequences: dominance reduction, then best fit, over a histogram of lengths.

A document is its token ids and a closing id. Longer ones are cut at the capacity. Pieces of one length are
interchangeable, so the driver plans on at most ``capacity`` counts, however many documents there are:

* Reduction after Martello and Toth. A set of pieces dominates others if any packing can be changed to hold it without
  more bins: a full piece alone; a piece whose smallest possible partner no longer fits, alone; two pieces that fill a
  bin exactly; a piece that has room for one partner only, with the longest that fits; a piece that has room for two
  partners only, with the longest one or the fullest two, where these dominate. Such sets are fixed for good and leave
  the instance; this is repeated as it shrinks.
* Best fit on the rest, longest first: each piece goes to the fullest bin that has room.

The plan says for each length which ranks go to which bins. Pieces of one length are dealt into groups of about
GROUP_ROWS; a piece's rank is its place in its group plus the size of the groups before, so no length is ever gathered
or sorted in one place. The driver gets a count for each length and each group.

Defined results: a null or empty text is one piece that holds only the closing id. Rows with repeated or null ids are
packed each for itself. An empty table gives an empty result. A long text is held by one task. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.llm._shared import ROW_BITS, gather, materialize, text_slices

CAPACITY = 2048
CLOSING_ID = 0
#: Pieces of one length in a group, on average.
GROUP_ROWS = 1_000_000
#: Chunks of texts whose ids are gathered at once.
GATHERED = 500_000

# Fixed value: the split pattern that is known never to join or drop anything but white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of such characters have one composed form and one lower case, and no white space inside.
SIMPLE = "^[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+$"

_PIECES = "number long, doc_id long, piece int, start long, length long, ids_crc32 long"


class Pieces(dict):
    """Ids of single pieces (what the pre-tokenizer makes), straight from the tokenizer's model; a bounded memory."""

    limit = 150_000

    def __init__(self, model):
        super().__init__()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.model, self.byte_letters = model, {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_letters)
        value = self[piece] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return value


def flat(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)) // 4


class Coder:
    """Ids of many texts at once.

    Where the tokenizer's steps are the known ones (composed form, white space, lower case, SPLIT, byte alphabet), it
    drops white space and never joins across it, so a text's ids are those of its chunks in order. Only the distinct
    chunks of a batch are coded: they are lower-cased and split here, and only distinct pieces reach the model. Chunks
    that are not SIMPLE, and whole texts with any other tokenizer, go through encode_batch.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode = whole.encode_batch
        told = json.loads(whole.to_str())
        self.special = [t["content"] for t in told["added_tokens"]]
        steps = (told["normalizer"] or {}).get("normalizers", [])
        cut = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        plain = plain and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " " and cut[0]["pattern"] == {"Regex": SPLIT}
        plain = plain and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        self.plain = plain and not any(c.isspace() for t in self.special for c in t)
        self.pieces = Pieces(whole.model)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk, one after another, and their numbers."""
        simple = pc.match_substring_regex(chunks, SIMPLE)
        for t in self.special:
            simple = pc.and_not(simple, pc.match_substring(chunks, t))
        low = pc.utf8_lower(chunks.filter(simple))
        mixed = pc.invert(pc.utf8_is_alpha(low))  # all others are one piece
        spaced = pc.ascii_rtrim_whitespace(pc.replace_substring_regex(low.filter(mixed), f"({SPLIT})", r"\1 "))
        parts = pc.ascii_split_whitespace(pc.replace_with_mask(low, mixed, spaced))
        named = pc.dictionary_encode(parts.flatten())
        if len(self.pieces) > Pieces.limit:
            self.pieces.clear()
        ids, counts = gather(*flat([self.pieces[p] for p in named.dictionary.to_pylist()]), named.indices.to_numpy())
        own = np.diff(np.r_[0, np.cumsum(counts)][parts.offsets.to_numpy()])
        rest = chunks.filter(pc.invert(simple)).cast(pa.large_binary()).to_pylist()
        others, more = flat(self._encoded([c.decode("utf-8", "replace") for c in rest]))
        order = np.argsort(~simple.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return gather(np.r_[ids, others], np.r_[own, more], place)

    def of_texts(self, texts: pa.Array, closing_id: int):
        """(ids, how many of each text) of all texts in order, some texts at a time; each text ends with closing_id."""
        end = np.array([closing_id], np.uint32)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.plain:
            for i in range(0, len(texts), 64):
                coded = self._encoded([t.decode("utf-8", "replace") for t in texts[i : i + 64].cast(pa.large_binary()).to_pylist()])
                yield flat([c + end.tobytes() for c in coded])
            return
        split = pc.ascii_split_whitespace(texts)
        named = pc.dictionary_encode(split.flatten())
        ids, counts = self.of_chunks(named.dictionary)
        ids, counts = np.r_[ids, end], np.r_[counts, 1]
        bounds, at = split.offsets.to_numpy(), named.indices.to_numpy()
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + GATHERED, "right")) - 1)
            stops = bounds[first + 1 : last + 1] - bounds[first]
            # The closing id is one more chunk behind each text.
            chunks = np.insert(at[bounds[first] : bounds[last]], stops, len(counts) - 1)
            out, n = gather(ids, counts, chunks)
            yield out, np.diff(np.r_[0, np.cumsum(n)[stops + np.arange(len(stops))]])
            first = last


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """Each document's pieces, with a number of their own."""
    names = ["number", "doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches):
        number = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            docs, done = batch.column("doc_id"), 0
            slices = (texts for _, texts in text_slices(batch.column("text")))
            for ids, n in (x for texts in slices for x in coder(tokenizer_path).of_texts(texts, closing_id)):
                times = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), times)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                at = (np.cumsum(n) - n)[doc] + start
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [np.arange(number, number + len(doc)), docs.take(pa.array(doc + done)), piece, start, length, crc]
                number, done = number + len(doc), done + len(n)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def fullest_pair(sizes: list[int], counts: dict[int, int], room: int) -> tuple[int, int]:
    """The two pieces (a, b; a >= b) with the greatest sum in the room; of equal sums the one with the longest piece."""
    best, i, j = (0, 0, 0), 0, len(sizes) - 1
    while i <= j:
        b, a = sizes[i], sizes[j]
        if a + b > room:
            j -= 1
        else:
            if a != b or counts[a] > 1:
                best = max(best, (a + b, a, b))
            i += 1
    return best[1:]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Takes dominating sets out of counts (length -> pieces); returns them as (((length, times), ...), bins).

    A set that dominates all others with its longest piece keeps doing so while pieces leave, so it is fixed as often as
    its pieces last.
    """
    fixed = []

    def fix(*lengths: int) -> None:
        times = Counter(lengths)
        bins = min(counts[x] // n for x, n in times.items())
        for x, n in times.items():
            counts[x] -= bins * n
            if not counts[x]:
                del counts[x]
        fixed.append((tuple(times.items()), bins))

    if capacity in counts:
        fix(capacity)
    for a in sorted((x for x in counts if 2 * x >= capacity), reverse=True):
        b = capacity - a
        if counts.get(a, 0) > (a == b) and counts.get(b):
            fix(a, b)
    while counts:
        longest = max(counts)
        room = capacity - longest
        others = {x: n - (x == longest) for x, n in counts.items() if n > (x == longest)}
        sizes = sorted(others)
        smallest = [x for x in sizes[:3] for _ in range(min(3, others[x]))][:3]
        fits = sum(s <= room for s in accumulate(smallest))
        if fits == 0:
            fix(longest)
            continue
        partner = max(x for x in sizes if x <= room)
        if fits == 1 or partner == room:
            fix(longest, partner)
            continue
        if fits == 3:
            break
        a, b = fullest_pair(sizes, others, room)
        if partner >= a + b:
            fix(longest, partner)
            continue
        # With the longest partner and b, any other two must have one no longer than b, or be the partner's equal.
        between = [x for x in sizes if b < x < a for _ in range(min(2, others[x]))][:2]
        if partner != a or (len(between) == 2 and sum(between) <= room):
            break
        fix(longest, a, b)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Longest first, each into the fullest bin with room; bins that hold the same lengths are kept as one group."""
    open_bins: dict[int, list] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: tuple, bins: int) -> None:
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append((pattern, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                pattern, bins = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(i)
            else:
                room, pattern, bins = capacity, (), left
            times = min(room // length, left)
            used = min(bins, left // times)
            put(room - times * length, (*pattern, (length, times)), used)
            if used < bins and pattern:
                put(room, pattern, bins - used)
            left -= used * times
    return [x for groups in open_bins.values() for x in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, times in a bin, offset), by first rank."""
    counts = dict(counts)
    rows, placed, bins_before = defaultdict(list), defaultdict(int), 0
    for pattern, bins in [*reduce_by_dominance(counts, capacity), *best_fit(counts, capacity)]:
        offset = 0
        for length, times in pattern:
            rows[length].append((placed[length], bins_before, times, offset))
            placed[length] += bins * times
            offset += length * times
        bins_before += bins
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    cut = materialize(pieces(documents, tokenizer_path, capacity, closing_id), "pieces")
    sizes = materialize(cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")  # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in sizes.collect()}
    group = F.pmod(F.xxhash64("number"), F.ceil(F.col("n") / GROUP_ROWS)).alias("group")
    dealt = cut.join(F.broadcast(sizes), "length").select(*cut.columns, group)
    starts: dict[int, list[int]] = defaultdict(list)
    before = dict.fromkeys(counts, 0)
    if sum(counts.values()) > GROUP_ROWS:
        for r in sorted(dealt.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each group
            starts[r["length"]] += [before[r["length"]]] * (r["group"] + 1 - len(starts[r["length"]]))
            before[r["length"]] += r["n"]
    first = {k: np.array(starts[k] or [0], np.int64) for k in counts}
    planned = documents.sparkSession.sparkContext.broadcast((plan(counts, capacity), first))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches):
        rows_of, first_of = planned.value
        for batch in batches:
            length, group, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "group", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                rows, at = rows_of[size], rank[own] + first_of[size][group[own]]
                row = rows[np.searchsorted(rows[:, 0], at, "right") - 1]
                nth = at - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 2]
                offset[own] = row[:, 3] + nth % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(sequence), pa.array(offset)], names)

    rank = F.row_number().over(Window.partitionBy("length", "group").orderBy("number")).cast("long") - 1
    ranked = dealt.select(*names[:5], "group", rank.alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
