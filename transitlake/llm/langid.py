"""Language identification by Bayesian evidence fusion.

For each page four sources of evidence about its language are combined:

* text: likelihood under a naive Bayes model of character 1- to 3-grams of words, whose counts are exact sums over all
  labelled documents by language; the model's size is that of the distinct 3-grams of letters;
* declaration: the page's ``lang`` attribute, with P(declared | language) estimated over all pages;
* address suffix: the host's last label and the path's language code, likewise;
* host: a prior smoothed hierarchically. The host's counts fall back on its registered domain's, these on all pages'.

The counts behind the last three are grouped sums of the text's posteriors over all pages; a page's own share is taken
out of its host's and domain's counts, so that nothing counts twice. Hot hosts are summed before any shuffle.

Text likelihoods are tempered: neighbouring n-grams repeat each other, so a text of n grams counts as TEXT_WEIGHT times
n, at most TEXT_MOST grams.

Defined results: a null or empty page has no text evidence and takes what its address and declaration give. Null
addresses have an empty host. Rows without labels of any language give null languages. Documents without a language
are not learnt from. Rows that repeat a page_id are pages each for itself. Of equally likely languages the first by name
is taken. An unclosed comment, script or the like hides the rest of a page. Pages may be very long: time is linear in
their length. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm._shared import materialize, text_slices
from transitlake.llm.markup import attributes, constructs

SMOOTHING = 0.5
TEXT_WEIGHT, TEXT_MOST = 0.3, 60.0
#: Pseudo-counts: of a host's domain, of a domain's whole, and of an evidence value under a language.
HOST_PRIOR, DOMAIN_PRIOR, VALUE_PRIOR = 4.0, 8.0, 1.0

#: Elements whose contents nobody sees.
HIDDEN = frozenset(("script", "style", "noscript", "template"))
_SUBTAG = re.compile(r"\s*([A-Za-z]{2,3})(?![A-Za-z])")
_BLANK = re.compile(r"[\W\d_]+")
#: Characters take 21 bits each in a gram's key, the last one lowest.
_BITS, _WORD_EDGE = np.uint64(21), np.uint64(0x20)


def visible(page: str | None) -> str:
    """A page's text without tags, scripts, styles and comments, in one pass."""
    page, at, out = page or "", 0, []
    for start, end, _ in constructs(page, HIDDEN):
        out.append(page[at:start])
        at = end
    return entities.unescape(" ".join([*out, page[at:]]))


def declared_lang(page: str | None) -> str:
    """The primary subtag of the first html element's lang attribute (or else xml:lang), or empty."""
    for start, end, name in constructs(page or "", HIDDEN):
        if name == "html":
            told = attributes(page[start:end])
            found = _SUBTAG.match(told.get("lang", "")) or _SUBTAG.match(told.get("xml:lang", ""))
            return found[1].lower() if found else ""
    return ""


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 3-grams of words with an edge at both ends, and which word each is of."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if not lengths.sum():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    at = np.flatnonzero(codes != _WORD_EDGE)
    return codes[at - 1] << (_BITS * np.uint64(2)) | codes[at] << _BITS | codes[at + 1], np.repeat(np.arange(len(words)), lengths)


def shorter_grams(threes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of 1-, 2- and 3-grams from the counts of 3-grams around each letter.

    A letter's 1-gram and the 2-grams before and behind it are parts of its 3-gram; keys of other lengths are marked.
    """
    two = np.uint64((1 << 42) - 1)
    mark = lambda k: np.uint64(k << 62)
    last = (threes & np.uint64((1 << 21) - 1)) == _WORD_EDGE
    parts = [(threes, n), (threes >> _BITS & two | mark(1), n), ((threes & two | mark(1))[last], n[last]), (threes >> _BITS & np.uint64((1 << 21) - 1) | mark(2), n)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _BLANK.sub(" ", text.lower()).split()


class TextModel:
    """Log probabilities of the known grams (sorted keys) and of any other one, by language."""

    def __init__(self, langs: list[str], of: np.ndarray, threes: np.ndarray, n: np.ndarray):
        """of: the language's place for each count n of a 3-gram."""
        self.langs = langs
        keys, counts = shorter_grams(threes, n)
        of = of if not len(n) else np.concatenate([of, of, of[(threes & np.uint64((1 << 21) - 1)) == _WORD_EDGE], of])
        self.keys, at = np.unique(keys, return_inverse=True)
        table = np.full((len(langs), len(self.keys)), SMOOTHING)
        np.add.at(table, (of, at), counts)
        whole = table.sum(axis=1, keepdims=True) + SMOOTHING
        self.logs, self.other = np.log(table / whole).astype(np.float32), np.log(SMOOTHING / whole[:, 0])

    def means(self, text: str) -> tuple[np.ndarray, int]:
        """Mean log probability of a text's grams by language, and their number."""
        threes, _ = word_grams(words_of(text))
        if not len(threes):
            return np.zeros(len(self.langs)), 0
        threes, n = np.unique(threes, return_counts=True)
        keys, n = shorter_grams(threes, n)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1) if len(self.keys) else np.zeros(len(keys), np.int64)
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        total = self.logs[:, at[known]].astype(np.float64) @ n[known] + self.other * n[~known].sum()
        return total / n.sum(), int(n.sum())


def text_model(documents: DataFrame) -> TextModel:
    """From all documents that have a language."""

    def count(batches):
        for batch in batches:
            names = batch.column("lang")
            for first, texts in text_slices(batch.column("text")):
                own = pc.dictionary_encode(names.slice(first, len(texts)))
                for i, lang in enumerate(own.dictionary.to_pylist()):
                    chunks = pc.utf8_split_whitespace(texts.filter(pc.equal(own.indices, i))).flatten()
                    named = pc.dictionary_encode(chunks)
                    times = np.bincount(named.indices.to_numpy(), minlength=len(named.dictionary))
                    split = [words_of(c) for c in named.dictionary.to_pylist()]
                    threes, of = word_grams([w for ws in split for w in ws])
                    if len(threes):
                        weight = np.repeat(times, [len(ws) for ws in split])
                        grams, at = np.unique(threes, return_inverse=True)
                        n = np.bincount(at, weight[of], len(grams)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], ["lang", "gram", "n"])

    known = documents.select("lang", "text").where("lang is not null")
    rows = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    rows = rows.filter(pc.greater(rows["n"], 0)).sort_by([("lang", "ascending"), ("gram", "ascending")])
    of = np.searchsorted(langs, rows["lang"].to_pylist()) if rows.num_rows else np.empty(0, np.int64)
    return TextModel(langs, of, rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy())


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(url: Column, host: Column) -> Column:
    """The host's last label, and a language code where the path starts with one."""
    code = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1))
    return F.concat_ws("/", F.substring_index(host, ".", -1), code)


def declared_in(page: Column) -> Column:
    """declared_lang of a column of pages."""

    @F.pandas_udf("string")
    def of(pages):
        import pandas as pd

        return pd.Series([declared_lang(x) for x in pages])

    return of(page)


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, declared, suffix and text: tempered log likelihoods in the order of the languages."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def likelihood(texts):
        import pandas as pd

        found = [sent.value.means(visible(page)) for page in texts]
        return pd.Series([(mean * min(TEXT_MOST, TEXT_WEIGHT * n)).tolist() for mean, n in found])

    host = host_of(F.col("url"))
    named = pages.select(
        "page_id",
        host.alias("host"),
        suffix_of(F.col("url"), host).alias("suffix"),
        declared_in(F.col("html")).alias("declared"),
        likelihood("html").alias("text"),
    )
    return named.withColumn("domain", domain_of(F.col("host")))


def _posterior(scores: Column) -> Column:
    most = F.array_max(scores)
    raw = F.transform(scores, lambda x: F.exp(x - most))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Sums of the posteriors by keys, as an array in the order of languages."""
    return rows.groupBy(*keys).agg(F.array(*(F.sum(F.col("p")[i]) for i in range(n))).alias(name))


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, host, lang, posterior, text_lang, declared, suffix: a row for each page row."""
    model = text_model(documents)
    langs = model.langs
    n = len(langs)
    if not n:
        host = host_of(F.col("url"))
        nothing = F.lit(None).cast("string")
        told = {"host": host, "lang": nothing, "posterior": F.lit(None).cast("double"), "text_lang": nothing, "declared": declared_in(F.col("html"))}
        told["suffix"] = suffix_of(F.col("url"), host)
        return pages.select("page_id", *(c.alias(k) for k, c in told.items()))
    rows = materialize(evidence(pages, model).withColumn("p", _posterior(F.col("text"))), "language-evidence")
    whole = _sums(rows, [], n, "w").first()["w"] or [0.0] * n
    total = [x or 0.0 for x in whole]
    share = F.array(*(F.lit((x + 1.0) / (sum(total) + n)) for x in total))
    hosts, domains = _sums(rows, ["host"], n, "of_host"), _sums(rows, ["domain"], n, "of_domain")

    def given(key: str) -> DataFrame:
        """log P(value | language) of each value, smoothed towards the value's share of all pages."""
        counts = _sums(rows, [key], n, "c").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("rows"))))  # one row
        each = [F.log((F.col("c")[i] + VALUE_PRIOR * F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / F.col("rows")) / (total[i] + VALUE_PRIOR)) for i in range(n)]
        return counts.select(key, F.array(*each).alias(f"log_{key}"))

    joined = rows.join(hosts, "host").join(domains, "domain").join(given("declared"), "declared").join(given("suffix"), "suffix")
    total_of = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    less = lambda a: F.zip_with(F.col(a), F.col("p"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    domain = F.zip_with(less("of_domain"), share, lambda x, s: (x + DOMAIN_PRIOR * s))
    joined = joined.withColumn("domain_prior", F.transform(domain, lambda x: x / (total_of(less("of_domain")) + DOMAIN_PRIOR)))
    prior = F.zip_with(less("of_host"), F.col("domain_prior"), lambda x, s: F.log((x + HOST_PRIOR * s) / (total_of(less("of_host")) + HOST_PRIOR)))
    joined = joined.withColumn("prior", prior)
    scores = F.array(*(F.col("text")[i] + F.col("log_declared")[i] + F.col("log_suffix")[i] + F.col("prior")[i] for i in range(n)))
    names = F.array(*(F.lit(x) for x in langs))
    joined = joined.withColumn("q", _posterior(scores))
    best = lambda a: names[(F.array_position(F.col(a), F.array_max(a)) - 1).cast("int")]
    return joined.select("page_id", "host", best("q").alias("lang"), F.array_max("q").alias("posterior"), best("p").alias("text_lang"), "declared", "suffix")
