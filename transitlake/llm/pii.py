"""Personal data by weak supervision. Built-in Spark expressions only on the data's path.

Candidate spans come from strict patterns (the base kinds) and from looser ones. Four labelers vote 1, 0 or abstain on
each: the strict pattern with its checks, a gazetteer of domains and reserved numbers, cue words before the span, and
the characters around it. Expectation-maximisation estimates each labeler's reliability per kind from the counts of
vote patterns alone, with no labels. Its posteriors then train the final span classifier, a naive Bayes over votes and
features of the span. Spans that the classifier accepts are added; spans of the base always stay.

What reaches the driver are counts of (kind, votes, features) patterns, whose number is bounded by PATTERN_BOUND,
however many spans there are; the counts cover all documents.

Defined results: null texts are empty. Every row gives one result row, rows that repeat a doc_id and null ids included;
an empty table gives an empty result. Other columns are ignored. Texts may be very long and hold very many spans; an added
span that overlaps a base span or an earlier added one is dropped. Of equal spans the first kind as listed stays. With no
candidates the classifier accepts nothing. What stands before a span is told up to the span of its pattern before it.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm._shared import materialize
from transitlake.llm.spans import blocks, cut, let, matches, running

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")

# Patterns of the base kinds. The tests in front say where a leftmost match can start, so that long runs
# are read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser patterns.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"

# Gazetteers and cue words.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "it", "uk", "eu", "us", "ca")
RESERVED = r"^(?:0|127|255)\.|^(?:000|666|9[0-9]{2})-|^0{4}|^\+?0{3}"
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write to|reach|correo|courriel)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip|address|host|server|adresse)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|credit|karte|tarjeta|carte)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|t[eé]l[eé]fono)\W*(?:\w+\W+){0,2}$",
    "ssn": r"(?i)(?:ssn|social security)\W*(?:\w+\W+){0,2}$",
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte)\W*(?:\w+\W+){0,2}$",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|section|ticket|serial|\bid|part no)\W*$"
CONTEXT = 40

LABELERS = ("strict", "gazetteer", "context", "edges")
FEATURES = ("length", "digits", "before")
#: kinds x votes x lengths x digit shares x characters before
PATTERN_BOUND = len(KINDS) * 3 ** len(LABELERS) * 5 * 4 * 4

CANDIDATE = "struct<start:int,rank:int,end:int,kind:string,base:boolean,strict:int,gazetteer:int,context:int,edges:int,length:int,digits:int,before:int>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.split(F.reverse(digits), "")
    each = F.filter(each, lambda c: c != "")
    value = lambda c, i: c.cast("int") * (1 + i % 2)
    folded = F.transform(each, lambda c, i: F.when(value(c, i) > 9, value(c, i) - 9).otherwise(value(c, i)))
    return F.aggregate(folded, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(text: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(text, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, 0 or -1 (abstains)."""
    out = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (out.otherwise(0) if no is None else out.when(F.coalesce(no, F.lit(False)), 0).otherwise(-1)).cast("int")


def _candidates(kind: str, found: Column, is_base: Column | bool, base_check) -> Column:
    def one(m: Column) -> Column:
        hit, start, end, before, after = m["text"], m["start"], m["end"], m["before"], m["after"]
        last = F.right(before, F.lit(1))
        base = F.coalesce(base_check(hit), F.lit(False)) if is_base else F.lit(False)
        known = F.lower(F.substring_index(F.regexp_replace(hit, r"[\])]", ""), ".", -1)).isin(*DOMAINS) if kind == "email" else F.lit(False)
        n = F.length(hit)
        share = F.length(_digits(hit)) / n
        return F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            base.alias("base"),
            _vote(base).alias("strict") if is_base else F.lit(-1).alias("strict"),
            _vote(known, hit.rlike(RESERVED)).alias("gazetteer"),
            _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)).alias("context"),
            _vote(~last.rlike(r"[\p{L}\p{N}_]") & ~after.rlike(r"[\p{L}\p{N}_]")).alias("edges"),
            F.when(n < 10, 0).when(n < 14, 1).when(n < 18, 2).when(n < 26, 3).otherwise(4).alias("length"),
            F.when(share == 0, 0).when(share < 0.5, 1).when(share < 0.85, 2).otherwise(3).alias("digits"),
            F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3).alias("before"),
        )

    return F.transform(found, one)


def candidates(text: Column) -> Column:
    """Array of candidate spans with votes and features, by start, then kind as listed."""
    has = lambda s: F.contains(text, F.lit(s))
    number = lambda low, high: lambda t: F.length(_digits(t)).between(low, high)
    yes = lambda t: F.lit(True)
    card = lambda t: number(14, 19)(t) & luhn(_digits(t))
    near = lambda pattern, maybe=None: matches(text, pattern, maybe, CONTEXT)
    parts = [
        _candidates("email", near(EMAIL, has("@")), True, yes),
        _candidates("ip", near(IP), True, _small_parts),
        _candidates("card", near(CARD), True, card),
        _candidates("phone", near(PHONE, has("+")), True, number(10, 15)),
        _candidates("email", near(LOOSE_EMAIL, has("at)") | has("at]")), False, None),
        _candidates("phone", near(LOOSE_PHONE), False, None),
        _candidates("ssn", near(SSN), False, None),
        _candidates("iban", near(IBAN), False, None),
    ]
    return F.array_sort(F.concat(*parts)).cast(f"array<{CANDIDATE}>")


def estimate(rows: list[dict], rounds: int = 30) -> tuple[dict[tuple, float], dict]:
    """Posterior of each (kind, votes) and the labelers' reliabilities by kind, from counts of vote patterns."""
    posteriors, reliability = {}, {}
    by_kind = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by_kind[r["kind"]][tuple(r[x] for x in LABELERS)] += r["n"]
    for kind, counts in by_kind.items():
        # The first round takes the majority of votes; the prior keeps labelers better than chance.
        p = {v: (1 + sum(x == 1 for x in v)) / (2 + sum(x >= 0 for x in v)) for v in counts}
        for _ in range(rounds):
            weight = {1: sum(n * p[v] for v, n in counts.items()) + 1.0, 0: sum(n * (1 - p[v]) for v, n in counts.items()) + 1.0}
            right = []
            for i in range(len(LABELERS)):
                yes = {c: (4.0 if c else 1.0) for c in (0, 1)}
                seen = {c: 5.0 for c in (0, 1)}
                for v, n in counts.items():
                    for c, share in ((1, p[v]), (0, 1 - p[v])):
                        if v[i] >= 0:
                            seen[c] += n * share
                            yes[c] += n * share * (v[i] == 1)
                right.append({c: yes[c] / seen[c] for c in (0, 1)})
            for v in counts:
                score = math.log(weight[1] / weight[0])
                for i, x in enumerate(v):
                    if x >= 0:
                        a, b = (right[i][1], right[i][0]) if x else (1 - right[i][1], 1 - right[i][0])
                        score += math.log(a / b)
                p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        reliability[kind] = dict(zip(LABELERS, right, strict=True))
        posteriors |= {(kind, *v): x for v, x in p.items()}
    return posteriors, reliability


def train(rows: list[dict]) -> dict[str, dict[str, float]]:
    """Log odds by kind: of the kind itself, and of each value of each vote and feature, from the posteriors."""
    posteriors, _ = estimate(rows)
    total = defaultdict(lambda: [1.0, 1.0])
    seen = defaultdict(lambda: [0.5, 0.5])
    for r in rows:
        p = posteriors[(r["kind"], *(r[x] for x in LABELERS))]
        for c, share in ((1, p), (0, 1 - p)):
            total[r["kind"]][c] += r["n"] * share
            for name in (*LABELERS, *FEATURES):
                seen[r["kind"], f"{name}={r[name]}"][c] += r["n"] * share
    model: dict[str, dict[str, float]] = {k: {"": math.log(t[1] / t[0])} for k, t in total.items()}
    for (kind, name), (no, yes) in seen.items():
        model[kind][name] = math.log(yes / (total[kind][1] + 1.0)) - math.log(no / (total[kind][0] + 1.0))
    return model


def fit(spans: DataFrame) -> dict[str, dict[str, float]]:
    """The classifier, from all rows of a table with an array column ``candidates``."""
    each = spans.select(F.explode("candidates").alias("c")).select("c.*")
    counts = each.groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    return train([r.asDict() for r in sorted(counts)])  # sorted, as sums of floats depend on their order


def accepted(spans: Column, model: dict[str, dict[str, float]], threshold: float = 0.5) -> Column:
    """Base spans, and those others that the classifier accepts and that overlap none before them."""
    flat = {f"{k}|{name}": w for k, weights in model.items() for name, w in weights.items()}
    weights = F.create_map(*(F.lit(x) for pair in flat.items() for x in pair)) if flat else F.create_map().cast("map<string,double>")
    weight = lambda s, name: F.coalesce(F.try_element_at(weights, F.concat(s["kind"], F.lit("|"), name)), F.lit(0.0))

    def score(s):
        out = weight(s, F.lit(""))
        for name in (*LABELERS, *FEATURES):
            out = out + weight(s, F.concat(F.lit(f"{name}="), s[name].cast("string")))
        return out

    # From the end: where the next base span starts. From the start: where the last base and added spans end.
    told = "struct<span:" + CANDIDATE + ",next:int>"
    back = lambda at, s: (F.when(s["base"], s["start"]).otherwise(at), F.struct(s.alias("span"), at.alias("next")))
    seen = lambda own: F.reverse(running(F.reverse(own), F.lit(2**31 - 1), back, told))
    ends = F.struct(F.lit(0).alias("base"), F.lit(0).alias("added"))

    def forth(last: Column, x: Column) -> tuple[Column, Column]:
        s = x["span"]
        free = (s["start"] >= last["base"]) & (s["start"] >= last["added"]) & (s["end"] <= x["next"])
        taken = ~s["base"] & free & (score(s) > math.log(threshold / (1 - threshold)))
        base = F.when(s["base"], F.greatest(last["base"], s["end"])).otherwise(last["base"])
        added = F.when(taken, s["end"]).otherwise(last["added"])
        return F.struct(base.alias("base"), added.alias("added")), F.when(s["base"] | taken, s)

    kept = lambda own: F.filter(running(seen(own), ends, forth, CANDIDATE), lambda s: s.isNotNull())
    # Where all spans are of the base there is nothing to weigh.
    return let(spans, lambda own: F.when(F.exists(own, lambda s: ~s["base"]), kept(own)).otherwise(own))


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id and spans (by start, then kind as listed) of each row."""
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(text.select("doc_id", candidates(F.col("text")).alias("candidates")), "pii-candidates")
    return found.select("doc_id", accepted(F.col("candidates"), fit(found)).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that starts inside another goes with it."""
    def marked(own: Column, parts: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            mark = F.concat(cut(parts, at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.greatest(at, s["end"]), F.when(s["start"] < at, F.lit("")).otherwise(mark)

        end = F.aggregate(own, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        return F.concat(F.array_join(running(own, F.lit(0), step, "string"), ""), F.substr(text, end + 1, F.lit(2**31 - 1)))

    return F.when(F.size(spans) > 0, let(spans, lambda own: let(blocks(text), lambda parts: marked(own, parts)))).otherwise(text)
