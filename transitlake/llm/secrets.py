"""Secret scans over history with an incremental ledger of blobs. Built-in Spark expressions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger says which (blob, rules) pairs have
been scanned and what was found; a scan reads only the pairs that it lacks, one copy of each blob however many paths
and versions share it, and findings are joined back to all of them. A new rule version scans all blobs once more and
leaves the old findings in place.

The rules are patterns with a check each; KINDS lists them in order. The first three are the base; the others add
well-known token formats.

Defined results: null contents are empty. Paths may be null or repeat; each version row gets its findings. Contents may
be very long. An empty table gives an empty result. Other columns are kept by nothing here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm._shared import materialize, scratch_root
from transitlake.llm.spans import matches

RULES = "1"
BASE = ("assign", "access", "hex")
# Formats of secrets.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}+"
MORE = {
    "pem": r"-----BEGIN (?:(?!PRIVATE KEY)[A-Z0-9]++ )*+PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "url": r"(?<![a-z])[a-z]{2,}+://[^\s:@/]++:[^\s:@/]{3,}+@",
}
#: What each of these needs somewhere in the text.
NEEDS = {"pem": "PRIVATE KEY-----", "github": "_", "jwt": "eyJ", "slack": "xox", "url": "://"}
KINDS = (*BASE, *MORE)

FINDINGS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def find_secrets(text: Column) -> Column:
    """Array of (start, rank, kind, end) by start, then kind as listed."""

    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    assigned = matches(text, ASSIGN, F.lower(text).rlike("password|passwd|secret|token|api_?key"))
    assigned = F.filter(assigned, lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 1)) >= 8)
    parts = [of("assign", assigned), of("access", matches(text, ACCESS, F.contains(text, F.lit("AKIA")))), of("hex", matches(text, HEX))]
    parts += [of(k, matches(text, p, F.contains(text, F.lit(NEEDS[k])))) for k, p in MORE.items()]
    return F.array_sort(F.concat(*parts)).cast(FINDINGS)


def address(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES) -> tuple[DataFrame, DataFrame]:
    """(the new ledger, addressed versions) from versions with path and content.

    The ledger has blob, rules and findings; pass the last one to scan only what it lacks.
    """
    spark = versions.sparkSession
    versions = versions.select("path", F.coalesce("content", F.lit("")).alias("content"))
    addressed = versions.select("path", address(F.col("content")).alias("blob"))
    unseen = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    # One row holds each unseen blob; it is found again by path and address, so contents move once and are never sorted.
    named = versions.withColumn("blob", address(F.col("content")))
    same = named["blob"].eqNullSafe(unseen["blob"]) & named["path"].eqNullSafe(unseen["path"])
    blobs = named.join(unseen.hint("shuffle_hash"), same, "left_semi")
    found = blobs.select("blob", find_secrets(F.col("content")).alias("findings"))
    found = found.where(F.size("findings") > 0).dropDuplicates(["blob"])
    new = unseen.select("blob").join(materialize(found, "secret-findings"), "blob", "left")
    new = new.select("blob", F.lit(rules).alias("rules"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
    return (new if ledger is None else ledger.select("blob", "rules", "findings").unionByName(new)), addressed


def findings(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES) -> tuple[DataFrame, DataFrame]:
    """(path, blob, findings of every version row; the ledger as written to the shared folder)."""
    spark = versions.sparkSession
    new, addressed = scan(versions, ledger, rules)
    path = f"{scratch_root(spark)}/secret-ledger-{uuid.uuid4().hex}"
    new.write.parquet(path)
    written = spark.read.schema(new.schema).parquet(path)
    own = written.where((F.col("rules") == rules) & (F.size("findings") > 0)).select("blob", "findings")
    joined = addressed.join(own, "blob", "left")
    return joined.select("path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")), written
