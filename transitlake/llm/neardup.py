"""Near-duplicate documents by HyperMinHash.

1. A document's set is its distinct SHINGLE-word shingles. Documents with equal sets are one class, shown by one row.
2. Sketch: for each of HASHES hash functions, the least value is kept as a register: its leading zeros and the
   MANTISSA bits after the first one. Registers take two bytes each. (One hash function for each register, not one
   function split into buckets: short documents would leave most buckets empty.)
3. Banding: BANDS bands of ROWS compressed registers. At a similarity of 0.75 a pair misses all bands with a
   probability of (1 - 0.75 ** 3) ** 32 < 3e-8.
4. In a bucket, pairs are not spelled out. Two rounds give each bucket a leader, the member that shares most buckets,
   and pair it with the members that are not yet in its component; that is linear. Then only buckets with more than one
   component matter. Their documents' pairs across components are found by an exact filter: shingles are ordered by
   rarity, and a link needs a common shingle within the first quarter of both sets, at places that leave room for the
   overlap. A large group of copies thus costs little, and no link between different components is lost.
5. A pair is estimated from its registers, corrected for registers that agree by chance, and drops out well below the
   threshold. The rest is confirmed on full sets of 64-bit shingle hashes.
6. Links are joined to components by alternating star contraction.

Defined results: documents without words have an empty set and are linked with nothing. Documents with fewer words than
a shingle have one shingle, all their words. Rows without doc_id get component null and are kept. Rows that repeat a
doc_id are one document with the union of their rows' links. Ties go to the smaller doc_id. An empty table gives an empty
result. Texts may be very long: a text and its set are held by one task. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from transitlake.llm._shared import bitmap, forget, hash_windows, hash_words, lower_ascii, materialize, probe, release_shuffles, space_words, text_batches

SHINGLE = 5
THRESHOLD = (75, 100)
ROWS, BANDS = 3, 32
HASHES = ROWS * BANDS
MANTISSA = 10
#: Pairs whose estimate is below this are dropped: six standard deviations under 0.75 at 96 registers.
ESTIMATE_FLOOR = 0.48
LEADER_ROUNDS = 2
#: Members of a bucket that one task joins, on average; buckets with more are split by hash.
BUCKET_ROWS = 1000
#: Rarity is counted in a table of this many slots; shingles that share one only look more frequent.
RARITY_BITS = 18

_random = np.random.default_rng(20240131)
_XOR = _random.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _random.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    hashes = hash_words(space_words(lower_ascii(text)))
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(hash_windows(hashes, min(size, len(hashes))))


def compress(least: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Registers of minimum values: leading zeros and the bits after the first one."""
    with np.errstate(divide="ignore"):
        exponent = np.where(least > 0, np.frexp(least.astype(np.float64))[1], 1).astype(np.int64)
    zeros = np.clip(64 - exponent, 0, 62)
    rest = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - mantissa)
    return (zeros.astype(np.uint16) << np.uint16(mantissa)) | rest.astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 2048):  # keeps the work in cache
        part = (shingles[None, i : i + 2048] ^ _XOR[:, None]) * _MULTIPLY[:, None]
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=1), out=least)
    return compress(least)


def chance_agreement(n: float, m: float, mantissa: int = MANTISSA) -> float:
    """Probability that registers of two disjoint sets of n and m elements agree."""
    zeros = np.arange(1, 48)[:, None]
    steps = np.arange(2**mantissa)[None, :] / 2**mantissa
    low = 2.0**-zeros * (1 + steps)
    high = low + 2.0 ** -(zeros + mantissa)
    inside = lambda k: np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(high, 1 - 1e-16)))
    return float((inside(n) * inside(m)).sum())


#: Sets whose sizes allow a link have nearly the same chance; it hardly depends on the size.
CHANCE = chance_agreement(1000, 1000)


def sketches(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, address (of the set), registers, bands of each row."""

    def of(batches):
        for ids, texts in text_batches(batches):
            n, address, registers, bands = [], [], [], []
            for text in texts:
                own = shingle_set(text, size)
                n.append(len(own))
                if not len(own):
                    address.append(None), registers.append(None), bands.append(None)
                    continue
                kept = sketch(own)
                whole = hash_windows(np.r_[own, np.uint64(len(own))], len(own) + 1) if len(own) < 8 else np.bitwise_xor.reduce((own ^ _XOR[:1, None]) * _MULTIPLY[:1, None], axis=1)
                address.append(int(whole[0].view(np.int64)))
                registers.append(kept.tobytes())
                rows = kept.reshape(BANDS, ROWS).astype(np.uint64)
                keys = ((rows[:, 0] << np.uint64(32)) | (rows[:, 1] << np.uint64(16)) | rows[:, 2]) ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(56))
                bands.append((keys * _MULTIPLY[0]).view(np.int64).tolist())
            columns = [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(address, pa.int64()), pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "address", "registers", "bands"])

    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return documents.mapInArrow(of, "doc_id long, n_shingles long, address long, registers binary, bands array<long>")


def _written_once(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges written to the shared folder, and a fingerprint of them taken on the way."""
    seen = Observation()
    own = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    out = materialize(own, "links")
    return out, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b); alternating stars."""
    edges, mark = _written_once(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour hangs on the smallest in the neighbourhood.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours and the node itself hang on the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new, new_mark = _written_once(small.where("a <> b").distinct())
        forget(edges)
        edges = new
        if new_mark == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = new_mark


def confirm(pairs: DataFrame, sketched: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that are links: by sizes, by estimate, then on full sets."""
    top, of = THRESHOLD
    side = lambda x: sketched.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(F.least("n_a", "n_b") * of >= F.greatest("n_a", "n_b") * top)

    def estimated(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("r_a", "r_b"))
            agree = (a == b).mean(axis=1)
            keep = pa.array((agree - CHANCE) / (1 - CHANCE) >= ESTIMATE_FLOOR)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(of * common >= top * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    near = near.select("a", "b", "r_a", "r_b").mapInArrow(estimated, "a long, b long")
    own = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s_{x}"))
    return near.join(own("a"), "a").join(own("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(linked, "a long, b long")


def _by_bucket(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """members with the columns of buckets (a row for each bucket, with n, its size), large buckets in parts."""
    parts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    own = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    told = buckets.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return own.join(told, ["bucket", "part"]).drop("part")


def _labelled(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """bucket, n, doc_id, mass, component of buckets that still hold more than one component."""
    nodes = components(links)
    own = buckets.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = own.select("bucket", "n", "doc_id", "mass", F.coalesce("component", "doc_id").alias("component"))
    mixed = own.groupBy("bucket").agg(F.max("n").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return materialize(_by_bucket(own, mixed.select("bucket", "n")), "mixed-buckets")


def _across(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be links, by the shingles that a link needs in common.

    A set of n has its shingles ordered by rarity. Sets that reach the threshold share one of the first
    n - ceil(0.75 n) + 1 of each, and behind the first they share there is room for their overlap. Any order that is
    the same for all sets will do, so rarity may be counted roughly.
    """
    top, of = THRESHOLD
    spark = mixed.sparkSession
    named = mixed.groupBy("doc_id").agg(F.first("component").alias("component"))
    own = materialize(sets.join(named, "doc_id").select("doc_id", "component", "shingles"), "mixed-sets")

    def count(batches):
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for x in batch.column("shingles").to_pylist():
                np.add.at(total, (np.frombuffer(x, np.uint64) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["slot", "n"])

    rows = own.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** RARITY_BITS rows
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    sent = spark.sparkContext.broadcast(counts)

    def prefixes(batches):
        for batch in batches:
            out = [np.empty(0, np.int64)] * 5
            parts = []
            for doc, component, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "component", "shingles")), strict=True):
                x = np.frombuffer(x, np.uint64)
                n = len(x)
                often = sent.value[(x >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
                order = np.lexsort((x, often))[: n - -(-top * n // of) + 1]
                at = np.flatnonzero(often[order] > 1)  # what is counted once is in no other set
                parts.append((x[order[at]].view(np.int64), np.full(len(at), doc), np.full(len(at), component), np.full(len(at), n), at))
            if parts:
                out = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["shingle", "doc_id", "component", "n", "at"])

    rare = materialize(own.mapInArrow(prefixes, "shingle long, doc_id long, component long, n long, at long"), "rare-shingles")
    side = lambda x: rare.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "component", "n", "at")))
    a, b = side("a"), side("b")
    overlap = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.col("component_a") < F.col("component_b")) & (F.least("n_a", "n_b") * of >= F.greatest("n_a", "n_b") * top)
    fits = fits & (overlap * (top + of) >= (F.col("n_a") + F.col("n_b")) * top)
    pairs = a.join(b, (a["shingle"] == b["shingle"]) & fits).select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))
    return pairs.distinct()


def near_links(documents: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(sketch table of all rows with the class each is shown by, links that span the components of shown documents, not all of them)."""
    spark: SparkSession = documents.sparkSession
    every = materialize(sketches(documents, size), "sketches")
    shown = every.where("address is not null and doc_id is not null").groupBy("address", "n_shingles").agg(F.min("doc_id").alias("shown"))
    shown = materialize(shown, "classes")
    sketched = every.join(shown.select("address", "n_shingles", F.col("shown").alias("doc_id")), ["address", "n_shingles", "doc_id"], "left_semi")
    sketched = materialize(sketched.select("doc_id", "n_shingles", "registers", "bands").dropDuplicates(["doc_id", "n_shingles", "registers"]), "shown-sketches")

    bands = sketched.select("doc_id", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs_of = materialize(bands.join(shared, "bucket"), "shared-buckets")
    mass = pairs_of.groupBy("doc_id").agg(F.sum("n").alias("mass"))
    buckets = materialize(pairs_of.join(mass, "doc_id").select("bucket", "n", "doc_id", "mass"), "buckets")
    forget(pairs_of)
    named = spark.sparkContext.broadcast(bitmap(buckets, "doc_id"))

    def full(batches):
        for ids, texts in text_batches(batches):
            wanted = probe(named.value, np.array([i or 0 for i in ids.to_pylist()], np.int64).view(np.uint64)).tolist()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(wanted, pa.int64())), pa.array([shingle_set(texts[i], size).tobytes() for i in wanted], pa.binary())], ["doc_id", "shingles"])

    # Documents without a shared bucket are left out before anything moves; a few may pass.
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sets = materialize(texts.mapInArrow(full, "doc_id long, shingles binary"), "candidate-sets")
    release_shuffles(spark)

    links = spark.createDataFrame([], "a long, b long")
    mixed = buckets.withColumn("component", F.col("doc_id"))
    for turn in range(LEADER_ROUNDS):
        lead = F.max(F.struct("mass", (-F.col("doc_id")).alias("o"), F.col("component").alias("c"))).alias("l")
        led = mixed.groupBy("bucket").agg(lead, F.max("n").alias("n"))
        if turn:  # the next leader is of another component than the first
            first = led.select("bucket", "n", F.col("l.c").alias("c"))
            led = _by_bucket(mixed, first).where("component <> c").groupBy("bucket").agg(lead, F.max("n").alias("n"))
        led = led.select("bucket", "n", (-F.col("l.o")).alias("a"), F.col("l.c").alias("other"))
        pairs = _by_bucket(mixed, led).where("component <> other").select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b"))
        links = links.unionByName(materialize(confirm(materialize(pairs.distinct(), "pairs"), sketched, sets), "confirmed"))
        release_shuffles(spark)
        mixed = _labelled(buckets if not turn else mixed.drop("component"), links)
    links = links.unionByName(materialize(confirm(materialize(_across(mixed, sets), "pairs"), sketched, sets), "confirmed"))
    release_shuffles(spark)
    return every.join(shown, ["address", "n_shingles"], "left"), links


def near_duplicates(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document row."""
    every, links = near_links(documents, size)
    # Members of a class hang on the one shown; rows that repeat a doc_id tie their classes together.
    member = every.where("shown is not null and shown <> doc_id").select(F.col("doc_id").alias("a"), F.col("shown").alias("b"))
    nodes = components(links.unionByName(member)).withColumnRenamed("node", "doc_id")
    out = every.select("doc_id", "n_shingles", "shown").join(nodes, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
