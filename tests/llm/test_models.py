"""Learnt operators: restoration, held-out accuracy, language evidence, the pipeline."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SYLLABLES = "ba ke li mo nu ra se ti vo da fe go".split()
RUDE = ("idiot", "scumbag", "worthless")


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(1), [], []
    for i in range(600):
        toxic, words = i % 4 == 0, sentence(rng, 40).split()
        if toxic:
            for _ in range(4):
                rude = rng.choice(RUDE)
                words[rng.randrange(40)] = rude if rng.random() < 0.8 else rude.replace("i", "1", 1).replace("o", "0", 1)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(900, None), (901, ""), (None, "1d1ot scum")]
    labels += [(900, 0), (None, 1), (902, None)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, corpus):
    from transitlake.llm.toxicity import held_out, score_documents

    docs, labels = corpus
    out = {r["doc_id"]: r for r in score_documents(docs, labels).collect()}
    assert len(out) == 603 and out[None]["held_out"] is False and 0 <= out[900]["score"] == out[901]["score"] < 0.3
    held = [i for i in range(600) if out[i]["held_out"]]
    assert 100 < len(held) < 200
    assert all(out[i]["predicted"] == (i % 4 == 0) for i in held)
    # Labels of the held-out fold don't matter.
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in score_documents(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(out[i]["score"], abs=1e-9) for i in held)


def test_no_labels_or_documents(spark, corpus):
    from transitlake.llm.toxicity import score_documents

    docs, labels = corpus
    assert score_documents(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in score_documents(docs, labels.limit(0)).collect()} == {0}


@pytest.fixture(scope="module")
def reader(spark, corpus):
    from transitlake.llm.toxicity import Reader, character_model

    return Reader(character_model(corpus[0]))


def holds(reader, text, word):
    """Whether all features of a word are among those of a text."""
    from transitlake.llm.toxicity import feature_slots

    return set(feature_slots([word])[0].tolist()) <= set(reader.of_texts(pa.array(["x", text, ""], pa.large_string()))[0].tolist())


@pytest.mark.parametrize("written", ["1d1ot", "i.d.i.o.t", "i d i o t", "idiooooot", "!d!0t", "sc.um.bag", "w0rthle55", "w-o-r-t-h-l-e-s-s"])
def test_restoration(reader, written):
    assert any(holds(reader, f"ba ke {written} nu ra", w) for w in RUDE)
    assert not any(holds(reader, "ba ke nu ra", w) for w in RUDE)


@pytest.mark.parametrize("written", ["i/d/i/o/t", "i,d,i,o,t", "i:d:i:o:t", "i#d#i#o#t", "i=d=i=o=t", "id^iot", "i·d·i·o·t", "iddiott", "i  d  i  o  t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "1#d#1#0#7"])
def test_all_alterations_are_read(reader, written):
    test_restoration(reader, written)


def model_of(words):
    from transitlake.llm.toxicity import CharacterModel, _codes

    keys = {}
    for word in words:
        codes = _codes(f"\x02\x02\x02{word}\x03").tolist()
        for i in range(3, len(codes)):
            key = codes[i - 3] << 48 | codes[i - 2] << 32 | codes[i - 1] << 16 | codes[i]
            keys[key] = keys.get(key, 0) + 1
    return CharacterModel(np.array(list(keys), np.uint64), np.array(list(keys.values()), float))


def test_words_without_letters():
    from transitlake.llm.toxicity import Reader

    reader = Reader(model_of(["ass", "bake"]))
    assert reader.words("@$$") == ["ass"] and reader.words("455") == ["ass"] and reader.words("9999") == []


@pytest.mark.parametrize("by", [" ", "."])
def test_long_chunks_are_read_whole(reader, by):
    # The second word lies over the 48th character; without breaks the run has over 40 letters.
    text = by.join("worthless" * 2 + "scumbag" + "worthless" * 3)
    found = reader.words(text)
    assert found.count("worthless") == 5 and found.count("scumbag") == 1
    assert holds(reader, text, "worthless") and holds(reader, text, "scumbag")
    assert holds(reader, "x" * 41 + "y", "x" * 41 + "y")


def test_plain_words_stay(reader):
    assert reader.words("bake") == ["bake", "bake"] and reader.words("108.51.216.133") == []


def plain_log(words, before, c):
    """log P(c | before) by counting in words."""
    p = 1e-6
    padded = [f"\x02\x02\x02{w}\x03" for w in words]
    for k, w in enumerate((0.02, 0.08, 0.3, 0.6), 1):
        context = before[len(before) - k + 1 :] if k > 1 else ""
        ends = [(x[i - k + 1 : i], x[i]) for x in padded for i in range(3, len(x))]
        n = sum(a == context for a, _ in ends)
        if n:
            p += w * sum(a == context and b == c for a, b in ends) / n
    return np.log(p)


def readings(chunk):
    """All ways through the lattice of a chunk: (restored, cost of the channel)."""
    from transitlake.llm import toxicity as T

    out = [("", 0.0)]
    for i, c in enumerate(chunk):
        new = []
        for text, cost in out:
            letters = ([(c, 0.0)] if c.isalpha() else []) + [(x, T.IMITATED) for x in T.IMITATES.get(c, "")]
            new += [(text + x, cost + y) for x, y in letters]
            last = text[-1:] if text[-1:] != " " else ""
            if c in T.MARKS or not letters:
                new.append((text, cost + T.DROPPED_MARK))
                if last:
                    new.append((text + " ", cost + T.BREAK))
            elif c == chunk[i - 1 : i] or letters[0][0] == last:
                new.append((text, cost + T.DROPPED_REPEAT))
            elif not c.isalnum():
                new.append((text, cost + 4 * T.IMITATED))
        out = new
    return out


def test_viterbi_takes_the_best_of_all_readings():
    from transitlake.llm.toxicity import restore

    words = ["idiot", "worthless", "bake", "ass", "loli", "a"]
    model = model_of(words)
    rng = random.Random(4)
    for before, c in (("\x02\x02\x02", "b"), ("\x02id", "i"), ("les", "s"), ("oss", "x"), ("iot", "\x03")):
        assert model.log(before, c) == pytest.approx(plain_log(words, before, c), abs=1e-5)

    def total(text, cost):
        for part in text.split(" ") if text else [""]:
            padded = f"\x02\x02\x02{part}\x03"
            if part or not text:
                cost += sum(model.log(padded[i : i + 3], padded[i + 3]) for i in range(len(part) + 1))
        return cost

    for _ in range(150):
        chunk = "".join(rng.choice("id1ot.@sabke$-") for _ in range(rng.randrange(1, 8)))
        best = max(total(t, c) for t, c in readings(chunk))
        assert total_of(restore(chunk, model), readings(chunk), total) == pytest.approx(best, abs=1e-6), chunk


def total_of(restored, ways, total):
    return max(total(t, c) for t, c in ways if t.strip() == restored)


def test_scores_are_those_of_a_plain_sum(spark, corpus):
    """A plain version on 200 rows: words by hand, features by slicing, the sum of their weights."""
    from transitlake.llm import toxicity as T

    docs, labels = corpus
    scorer = T.train(docs, labels)
    rows = docs.where("doc_id < 200").select("doc_id", "text").collect()
    got = dict(docs.where("doc_id < 200").select("doc_id", T.score(F.col("text"), scorer, spark).alias("s")).collect())
    model = scorer.reader.model

    def slots(word):
        edged = [ord(c) for c in f"^{word}$"]
        whole = sum(c * pow(1_000_003, i, 1 << 64) for i, c in enumerate(edged))
        grams = []
        for i in range(len(edged) - 4):
            value = 5
            for c in edged[i : i + 5]:
                value = value * 1_000_003 + c
            grams.append(value)
        return {((v % (1 << 64)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - T.FEATURE_BITS) for v in [whole, *grams]} if len(word) > 2 else set()

    for doc, text in rows:
        found = set()
        for chunk in text.split():
            odd = not chunk.isalpha() or any(a == b for a, b in zip(chunk, chunk[1:]))
            read = [*T.restore(chunk, model).split(), *re.findall(r"[^\W\d_]+", chunk)] if odd else [chunk]
            for word in read:
                found |= slots(word)
        z = scorer.bias + sum(float(scorer.weights[i]) for i in found)
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


@pytest.mark.parametrize("text", ["a!" * 500_000, "a" + "!" * 10**6, "." * 10**6, "a.b " * 250_000, "ab " * 300_000, "deadbeef01" * 100_000])
def test_long_texts_take_linear_time(reader, text):
    began = time.perf_counter()
    reader.of_texts(pa.array([text], pa.large_string()))
    assert time.perf_counter() - began < 20


def test_toxicity_of_odd_tables(spark, corpus):
    """Repeated rows, contradicting labels, columns with clashing names, invalid empty texts."""
    from transitlake.llm.toxicity import score_documents

    rows = [(1, "worthless", 1, 0.5), (1, "worthless", 1, 0.5), (1, "ba ke", 0, 0.1), (None, None, None, None), (2, " \n ", 1, 0.0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double").withColumn("labelled", F.lit(1))
    labels = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 1, "x"), (5, 1, "y"), (3, None, "z")], "doc_id long, toxic int, text string")
    out = score_documents(docs, labels).collect()
    assert len(out) == 15 and all(0 <= r["score"] <= 1 for r in out)


def test_language(spark):
    from transitlake.llm.langid import identify

    rng = random.Random(2)
    words = {"en": "the and with this that from have".split(), "de": "der und mit nicht eine auch wird".split(), "fr": "les dans avec pour une est vous".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x, 40), x) for i, x in enumerate(["en", "de", "fr"] * 20)] + [(99, "x", None)], "doc_id long, text string, lang string")
    pages = [(i, f"https://{x}{i % 3}.example.{x}/{x}/{i}", f'<html lang="{x}"><script>der und mit</script><body><p>{say(x, 12)}</p></body></html>') for i, x in enumerate(["en", "de", "fr"] * 20)]
    pages += [(100, "https://de0.example.de/de/1", '<html lang="de"><p>1 2 3</p></html>'), (101, None, None), (102, "https://www.fr1.example.fr:80/x?y#z", ""), (103, "https://en0.example.en/en/9", f'<html lang="de"><p>{say("en", 40)}</p></html>')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    out = {r["page_id"]: r for r in identify(df, docs).collect()}
    assert len(out) == len(pages)
    assert all(out[i]["lang"] == x for i, x in enumerate(["en", "de", "fr"] * 20))
    assert out[100]["lang"] == "de" and out[102]["lang"] == "fr" and out[103]["lang"] == "en" and out[101]["lang"] is not None
    assert out[102]["host"] == "fr1.example.fr" and out[101]["host"] == ""
    assert all(0 < r["posterior"] <= 1 for r in out.values())
    assert identify(df.limit(0), docs).count() == 0
    assert {r["lang"] for r in identify(df, docs.limit(0)).collect()} == {None}


def plain_language(pages, docs):
    """Evidence fusion in plain Python: page_id -> (best language, posterior) by counting in dictionaries."""
    import math
    from collections import Counter, defaultdict

    from transitlake.llm import langid as L

    def grams(text):
        out = Counter()
        for w in re.sub(r"[\W\d_]+", " ", text.lower()).split():
            e = f" {w} "
            out.update(e[i : i + 3] for i in range(len(w)))
            out.update(e[i : i + 2] for i in range(len(w) + 1))
            out.update(w)
        return out

    langs = sorted({lang for _, _, lang in docs if lang})
    count = {x: Counter() for x in langs}
    for _, text, lang in docs:
        if lang:
            count[lang] += grams(text or "")
    known = set().union(*count.values())
    whole = {x: sum(count[x].values()) + L.SMOOTHING * (len(known) + 1) for x in langs}
    norm = lambda z: [math.exp(a - max(z)) / sum(math.exp(b - max(z)) for b in z) for a in z]
    rows = []
    for page, url, html in pages:
        own = grams(re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<script.*?</script>", " ", html or "")))
        n = sum(own.values())
        mean = [sum(k * math.log((count[x][g] + L.SMOOTHING) / whole[x]) for g, k in own.items()) / n if n else 0.0 for x in langs]
        text = [m * min(L.TEXT_MOST, L.TEXT_WEIGHT * n) for m in mean]
        host = re.sub(r"^(?:www|m)\.", "", (re.match(r"[a-z]+://([^/:?#]*)", url or "") or ["", ""])[1])
        code = (re.match(r"[a-z]+://[^/]*/([a-z]{2})(?:/|$)", url or "") or ["", ""])[1]
        declared = (re.search(r'<html\b[^>]*?\blang="([a-z]{2})"', html or "") or ["", ""])[1]
        rows.append((page, host, ".".join(host.split(".")[-2:]), declared, "/".join([host.split(".")[-1], code]), text, norm(text)))
    total = [sum(r[6][i] for r in rows) for i in range(len(langs))]
    sums = [defaultdict(lambda: [0.0] * len(langs)) for _ in range(4)]
    for r in rows:
        for j in range(4):
            sums[j][r[j + 1]] = [a + b for a, b in zip(sums[j][r[j + 1]], r[6])]
    out = {}
    for r in rows:
        score = list(r[5])
        of_domain = [max(a - b, 0.0) for a, b in zip(sums[1][r[2]], r[6])]
        of_host = [max(a - b, 0.0) for a, b in zip(sums[0][r[1]], r[6])]
        for i in range(len(langs)):
            share = (total[i] + 1) / (sum(total) + len(langs))
            domain = (of_domain[i] + L.DOMAIN_PRIOR * share) / (sum(of_domain) + L.DOMAIN_PRIOR)
            score[i] += math.log((of_host[i] + L.HOST_PRIOR * domain) / (sum(of_host) + L.HOST_PRIOR))
            for j, key in ((2, r[3]), (3, r[4])):
                value = sums[j][key]
                score[i] += math.log((value[i] + L.VALUE_PRIOR * sum(value) / len(rows)) / (total[i] + L.VALUE_PRIOR))
        q = norm(score)
        out[r[0]] = langs[q.index(max(q))], max(q)
    return out


def test_language_is_that_of_a_plain_version(spark):
    from transitlake.llm.langid import identify

    rng = random.Random(12)
    words = {x: [word(rng) + tail for _ in range(30)] for x, tail in (("en", "th"), ("de", "ch"), ("fr", "é"))}
    say = lambda n: " ".join(rng.choice(words[rng.choice(["en", "de", "fr", "de"])]) for _ in range(n))
    docs = [(i, " ".join(rng.choice(words[x]) for _ in range(20)), x) for i, x in enumerate(["en", "de", "fr"] * 10)] + [(50, None, "en"), (51, "abc", None)]
    pages = [(i, f"https://{rng.choice(['www.', '', 'm.'])}h{i % 7}.d{i % 3}.{rng.choice(['com', 'de', 'fr'])}/{rng.choice(['de', 'en', 'index'])}/", f'<html lang="{rng.choice(["de", "en", "fr"])}"><p>{say(rng.randrange(6))}</p>') for i in range(198)]
    pages += [(500, None, None), (501, "", "<p>" + say(3))]
    got = {r["page_id"]: r for r in identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    for page, (lang, posterior) in plain_language(pages, docs).items():
        assert got[page]["lang"] == lang and got[page]["posterior"] == pytest.approx(posterior, abs=1e-5), page


@pytest.mark.parametrize(
    ("page", "lang"),
    [
        ('<html data-lang="fr" lang="en">', "en"),
        ('<!-- <html lang="de"> --><html lang="en">', "en"),
        ('<html xml:lang="fr" lang="en">', "en"),
        ('<html title="a>b" lang="en">', "en"),
        ("<HTML LANG=pt-BR>", "pt"),
        ("<html xml:lang='es'>", "es"),
        ('<script>"<html lang=de>"</script ><html lang = "fr">', "fr"),
        ('<html lang="">', ""),
        ("<p lang='en'>", ""),
        ("<html lang='en", ""),
        (None, ""),
    ],
)
def test_declared_language(page, lang):
    from transitlake.llm.langid import declared_lang

    assert declared_lang(page) == lang


def test_visible_text():
    from transitlake.llm.langid import visible

    assert visible("a < b and c > d").split() == "a < b and c > d".split()
    assert visible("x<script>no</script y>z<!-- n -->u&amp;v").split() == ["x", "z", "u&v"]
    assert visible('<a title="b>c">d</a>').split() == ["d"] and visible(None) == ""


def test_scores_do_not_follow_the_order_of_rows(spark, corpus):
    """The same rows in three orders and partitionings, a third of them copies under other ids: equal scores."""
    from transitlake.llm.toxicity import score_documents

    docs, labels = corpus
    copies = docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 100_000)
    more = labels.unionByName(labels.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 100_000))
    both = docs.unionByName(copies)
    found = []
    for parts, order in ((1, F.col("doc_id")), (3, F.xxhash64("doc_id")), (5, F.desc("doc_id"))):
        rows = score_documents(both.repartition(parts).orderBy(order), more.orderBy(order)).collect()
        found.append(sorted((r["doc_id"], r["score"]) for r in rows))
    assert found[0] == found[1] == found[2]


def test_fit_reads_its_sample_in_parts(spark, corpus, monkeypatch):
    """Parts of any size give every row once, in the order of their keys."""
    from transitlake.llm import toxicity as T

    docs, labels = corpus
    monkeypatch.setattr(T, "PART_CHARS", 3000)
    sample = T.Sample(T._sampled(docs, labels, 10_000), T.character_model(docs))
    rows = [len(toxic) for _, toxic in sample]
    assert sample.parts > 3 and len(rows) == sample.parts and max(rows) < sum(rows) / 2
    assert sum(rows) == docs.join(labels.where("toxic in (0, 1)"), "doc_id").select("text", "toxic").distinct().count()


@pytest.mark.parametrize("page", ["<!--" * 250_000, "<script>" * 130_000, "<" * 10**6, "<html " * 170_000, "<html lang " * 90_000, "</script <script>" * 60_000, "a " * 500_000])
def test_long_pages_take_linear_time(spark, page):
    from transitlake.llm.langid import declared_in, visible

    began = time.perf_counter()
    visible(page)
    spark.createDataFrame([(page,)], "html string").select(declared_in(F.col("html"))).collect()
    assert time.perf_counter() - began < 10


def test_what_is_visible():
    from transitlake.llm.langid import visible

    assert visible("a<b>c</b><!-- x > y -->d<SCRIPT>1 < 2</Script >e &amp; f").split() == ["a", "c", "d", "e", "&", "f"]
    assert visible("a<style>b").split() == ["a"] and visible("a <b c").split() == ["a", "<b", "c"] and visible(None) == ""


def test_repeated_and_equal_pages(spark):
    from transitlake.llm.langid import identify

    docs = spark.createDataFrame([(1, "ab", "xx"), (2, "ab", "aa")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "u", "ab", "c")] * 3 + [(None, "u", "zz", "c")], "page_id long, url string, html string, host string")
    assert sorted((r["page_id"] or 0, r["lang"], round(r["posterior"], 6)) for r in identify(pages, docs).collect()) == [(0, "aa", 0.5)] + [(1, "aa", 0.5)] * 3


def test_declared_after_long_attributes(spark):
    from transitlake.llm.langid import declared_in

    pages = spark.createDataFrame([(f'<html prefix="{"x" * 2000}" lang="de"><p lang="fr">',), (f'<html prefix="{"x" * 2000}"><p lang="fr">',)], "html string")
    assert [r[0] for r in pages.select(declared_in(F.col("html"))).collect()] == ["de", ""]


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    rng, docs, labels = random.Random(3), [], []
    for i in range(200):
        words = sentence(rng, 60).split()
        if i % 5 == 0:
            for _ in range(5):
                words[rng.randrange(60)] = rng.choice(RUDE)
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    copied = next(d for d in docs if d[0] == 11)[1]
    item = sentence(rng, 12)
    docs += [(300, copied, "en", "s", 1), (301, copied + " more", "en", "s", 1), (302, f"{sentence(rng, 20)} {item} {sentence(rng, 20)}", "en", "s", 1), (303, f"{sentence(rng, 30)} a.b@c.de", "en", None, None), (304, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, df = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in df.select("doc_id").collect()}
    rude = {i for i in range(0, 200, 5)}
    assert kept["toxicity"] == {d[0] for d in docs} - rude
    assert kept["near_dedup"] == kept["toxicity"] - {300, 301}
    assert kept["decontamination"] == kept["near_dedup"] - {302}
    assert kept["pii"] == kept["decontamination"] == kept["packing"]
    masked = spark.read.parquet(f"{tmp_path}/pii").where("doc_id = 303").first()
    assert masked["text"].endswith("[EMAIL]") and masked["n_chars"] == len(masked["text"])
    assert C.run(spark, str(tmp_path)).count() == df.count()
    # Odd tables go through each stage: none of its rows, repeated rows, null ids, columns with the names used inside.
    odd = spark.createDataFrame([(None, None, "en", "s", 1), (7, "mail a.b@c.de", None, None, None), (7, "mail a.b@c.de", None, None, None)], schema)
    odd = odd.withColumns({c: F.lit(1) for c in ("_spans", "_gone", "toxic", "score")})
    for name, stage in C.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, odd, str(tmp_path))
        assert out.count() == 3 and (name == "packing" or out.columns == odd.columns), name
