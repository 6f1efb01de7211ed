"""Source audit, spelling variants and page extraction against plain versions, and their defined results on odd inputs."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

DOCS = "doc_id long, text string, lang string, source string, term string, word string, n long, vector string, rank int"


def docs_table(spark, rows):
    """rows: doc_id, text, lang, source; with columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, "t", "w", 1, "v", 2) for r in rows], DOCS).repartition(3)


def plain_audit(rows, min_df=10, top=10):
    """lang, source, part, item, value, rank."""
    told = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for _, text, lang, source in rows]
    out = []
    for lang in {t[0] for t in told}:
        df = Counter(w for l, _, ws in told if l == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= min_df)
        counts = {s: Counter() for l, s, _ in told if l == lang}
        for l, s, ws in told:
            if l == lang:
                counts[s].update(ws)
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s)
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            own = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w])
            out += [(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(own[:top], 1)]
    return out


def audit_rows():
    rng, rows = random.Random(5), []
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Été", "ñandú", "A", "日本"]
    for i in range(160):
        source = "hot" if i % 3 == 0 else rng.choice(["b", "c", "d", None, "é"])
        lang = rng.choice(["en", "en", "de", None])
        rows.append((i, " ".join(rng.choices(words[i % 5 :: 2], k=rng.randrange(1, 60))), lang, source))
    rows += [(200, None, "en", "silent"), (201, "", "xx", "one"), (None, "wab wac 12 3", "en", "b"), (3, "wab", "en", "b"), (3, "wab", "en", "b"), (202, "only here", "yy", "a"), (203, "", "yy", "b")]
    rows += [(300 + i, f"rare{chr(97 + i)} term", "zz", "a" if i % 2 else "b") for i in range(9)] + [(320 + i, f"x{chr(97 + i)}", "zx", "a" if i % 2 else "b") for i in range(12)]
    rows += [(204, "wab " * 30_000 + "waé", "en", "long")]
    return rows


def audited(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_the_plain_version(spark):
    from transitlake.llm.divergence import audit_sources

    rows = audit_rows()
    assert audited(audit_sources(docs_table(spark, rows))) == sorted(plain_audit(rows))


def test_audit_in_shards_of_terms(spark):
    """Vocabularies dealt to several models add up to one."""
    from transitlake.llm.divergence import divergence, group_counts

    rows = [r for r in audit_rows() if (r[2] or "") == "en"]
    df = docs_table(spark, rows)
    counts = group_counts(df, model_terms=40)
    groups = spark.createDataFrame(list({(r[2] or "", r[3] or "") for r in rows}), "lang string, source string")
    assert audited(divergence(counts, groups)) == sorted(plain_audit(rows))


def test_audit_of_tables_without_terms(spark):
    from transitlake.llm.divergence import audit_sources

    assert audit_sources(docs_table(spark, []).limit(0)).count() == 0
    rows = [(1, None, None, "a"), (2, "x", None, "b"), (3, "x", "en", None)]
    assert audited(audit_sources(docs_table(spark, rows))) == sorted(plain_audit(rows)) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_shares_of_very_large_counts(spark):
    from pyspark.sql import functions as F

    from transitlake.llm.divergence import _share

    n, total, v = 700_000_000_000, 9_000_000_000_000_000, 10**9
    row = spark.createDataFrame([(n, total, v)], "n long, t long, v long").select(_share(F.col("n"), F.col("t"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * v)


def plain_spelling(rows, min_length=6, min_count=5):
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near, form = defaultdict(list), {}
    for a in words:
        near[a] = [b for b in words if edit(a, b)]
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        if best and words[best] >= 5 * words[a]:
            form[a] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def spelling_rows():
    rng, rows = random.Random(9), []
    stems = ["letter", "banana", "aaaaaa", "straße", "évidemment", "mississippi", "abcabcabc", "internal"]
    words = set(stems)
    for s in stems:  # every kind of edit at every place
        for i in range(len(s) + 1):
            words |= {s[:i] + rng.choice("axé") + s[i:], s[:i] + rng.choice("bzü") + s[i + 1 :], s[:i] + s[i + 1 :]}
    for w in sorted(words):
        rows += [(rng.randrange(50), w if rng.random() < 0.8 else w.capitalize()) for _ in range(rng.choice([4, 5, 6, 40]))]
    rows += [(i, "letter " * 400) for i in range(4)] + [(i, "lettern " * 60) for i in range(4)]
    rows += [(None, "unnamed " * 20), (None, None), (7, ""), (8, "× ÷ 123"), (7, "x"), (9, "evidence×evidence " * 200), (9, "evidence " * 5)]
    rows += [(1000 + i, "planted planted planted") for i in range(600)]
    rows.append((2000, "longer " * 200_000))
    return rows


def test_spelling_equals_the_plain_version(spark):
    from transitlake.llm.spelling import spelling_variants

    rows = spelling_rows()
    out = spelling_variants(docs_table(spark, [(*r, "en", "s") for r in rows]))
    assert {tuple(r) for r in out.select("word", "n", "n_near", "form", "form_n", "root").collect()} == plain_spelling(rows)
    assert out.count() == out.select("word").distinct().count()


def test_spelling_of_tables_without_words(spark):
    from transitlake.llm.spelling import spelling_variants

    assert spelling_variants(docs_table(spark, []).limit(0)).count() == 0
    assert spelling_variants(docs_table(spark, [(1, None, "en", "s"), (2, "short words only", "en", "s")])).count() == 0


def test_roots_of_long_chains(spark):
    """Counts 5, 25, ... 3125 of words that differ by one letter each from the next."""
    from transitlake.llm.spelling import spelling_variants

    chain = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(i, " ".join([w] * 5 ** (k + 1))) for k, w in enumerate(chain) for i in [[1, 3, 4, 6, 8][k]]]
    found = {r["word"]: r for r in spelling_variants(docs_table(spark, [(*r, "en", "s") for r in rows])).collect()}
    assert found["abcdef"]["root"] == "abcdefghij" and found["abcdef"]["form"] == "abcdefg" and found["abcdefghij"]["root"] == "abcdefghij"


def test_candidates_stay_few_where_halves_are_common(spark):
    """Words of one hot first half: what meets is far below all pairs."""
    from pyspark.sql import functions as F

    from transitlake.llm import spelling as S

    rng = random.Random(2)
    words = {"common" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    keys = df.select(F.explode(F.array(*S._keys(F.col("word"), F.length("word"), 0))).alias("k"))
    met = keys.groupBy("k").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert met < 60 * len(words)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies on this page and you may agree to all of them</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b> paragraph<br>with a&nbsp;break.<p>Second</p>
<div class="ad-slot">Buy this now, it is very cheap and very good and very long</div><ul><li>one<li>two</ul>
<table><tr><td>a<td>b</table><aside>Sidebar</aside><form><input><label>Name</label><button>Go</button></form>
<section id="comments"><article><p>A reader's comment that is long enough to look like content of the page.</p></article></section></article></main>
<footer>&copy; all</footer><script>var x = "<article><p>no</p></article>";</script ></body></html>"""


def test_article_of_a_whole_page():
    from transitlake.llm.extract import main_text

    assert main_text(PAGE) == "Title & more\nFirst bold paragraph with a break.\nSecond\none\ntwo\na\nb"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("<nav>only a menu</nav>", ""),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<article>x<!-- > <p>no</p> --> y<!--> z</article>", "x y z"),
        ('<article title="a>b">x</article>', "x"),
        ("<article><p>one</p><p>two</article>", "one\ntwo"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut <a hre", "cut"),
        ("<article><p>cut <!-- open", "cut"),
        ("<article><p>cut <script>x", "cut"),
        ("<article><p>&lt;b&gt; &#233; &eacute; &unknown;</p></article>", "<b> é é &unknown;"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<div>body<div class='comments-area'>no</div><div class='no-comments'>yes</div></div>", "body\nyes"),
        ("<article>a<span class='advert'>no <span>no</span> no</span>b</article>", "a\nb"),
        ("<form>" + "<p>whole page in a form</p>" * 3 + "</form>", "\n".join(["whole page in a form"] * 3)),
        ("<article><dl><dt>t<dd>d<dt>u<dd>e</dl></article>", "t\nd\nu\ne"),
        ("<article><p><i>a<p>b</i> c</p>d</article>", "a\nb c\nd"),
    ],
)
def test_pages(html, text):
    from transitlake.llm.extract import main_text

    assert main_text(html) == text


def test_content_without_a_declared_article():
    from transitlake.llm.extract import main_text

    long = "words of a long paragraph " * 12
    html = f"<body><div class=top><a href=1>One</a> <a href=2>Two</a></div><div id=w><h1>Title</h1><div><p>{long}</p><p>{long}</p><p>end.</p></div></div><div><ul><li><a href=3>Else</a><li><a href=4>More</a></ul></div></body>"
    assert main_text(html) == f"Title\n{long.strip()}\n{long.strip()}\nend."


def test_ratios_are_smoothed_and_clustered():
    import numpy as np

    from transitlake.llm import extract as X

    chars, tags = np.array([2, 3, 2, 90, 4, 120, 80, 2, 3]), np.array([2, 2, 2, 1, 1, 1, 1, 2, 2])
    smooth = X.ratios(chars, tags)
    assert abs(X.ratios(np.full(7, 10), np.ones(7)) - 10).max() < 1e-9
    assert smooth[4] > 40 > smooth[0]
    assert X.clusters(chars, tags).nonzero()[0].tolist() == [3, 4, 5, 6] or X.clusters(chars, tags)[3:7].all()
    assert not X.clusters(chars, tags)[[0, 8]].any()


def test_hostile_pages_take_linear_time():
    from transitlake.llm.extract import main_text

    n = 100_000
    for html in ("<" * n, "</" * n, "<!--" * n, "<b>" * n + "</i>" * n, "<p>" * n, "<div>" * n + "x" + "</div>" * n, '<a x="' * n, "<li>a" * n, "<table><tr>" + "<td>a" * n, "&" * n, "<![x " * n + ">", "<a " + "x " * n + ">", "<i><p>" + "<b>" * n + "</i>" * n):
        began = time.perf_counter()
        main_text(html)
        assert time.perf_counter() - began < 20


def test_extract_of_odd_tables(spark):
    from transitlake.llm.extract import extract

    rows = [(1, "u", PAGE, "t", 5), (1, "u", PAGE, "t", 5), (None, None, None, None, None), (2, "v", "<article>" + "<p>x &lt; y</p>" * 100_000 + "</article>", "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    out = {(r["page_id"], r["url"]): r for r in extract(df).collect()}
    assert out[None, None]["text"] == "" and out[None, None]["n_chars"] == 0
    assert out[1, "u"]["n_chars"] == len(out[1, "u"]["text"]) > 50 and out[2, "v"]["n_chars"] == 100_000 * 6 - 1
    assert extract(df).count() == 4 and extract(df.limit(0)).count() == 0


def plain_nearest(vectors, k=20):
    import numpy as np

    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids])
    scores = table @ table.T
    np.fill_diagonal(scores, -np.inf)
    return {int(q): [int(ids[j]) for j in np.lexsort((ids, -scores[i]))[:k]] for i, q in enumerate(ids) if q % 20 == 0}


def hub_vectors(n=1200, width=12):
    import numpy as np

    rng = np.random.default_rng(3)
    table = rng.standard_normal((n, width))
    table[7] *= 100  # in nearly every list
    return {i: table[i] for i in range(n)}


def test_exact_neighbours(spark):
    from pyspark.sql import functions as F

    from transitlake.llm.neighbours import exact_nearest

    vectors = hub_vectors(500)
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(9000, None), (9020, [0.0] * 12), (None, [1.0] * 12), (9040, [float("nan")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in exact_nearest(df, F.col("vec_id") % 20 == 0, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == plain_nearest(vectors)
    assert exact_nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(45)], "vec_id long, embedding array<double>")
    first = exact_nearest(same, F.col("vec_id") == 40, block=8).orderBy("rank").collect()
    assert [r["vec_id"] for r in first] == list(range(20))


def test_a_hub_costs_no_recall_and_is_no_hot_key(spark):
    from pyspark.sql import functions as F

    from transitlake.llm import neighbours as N

    vectors = hub_vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in N.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = plain_nearest(vectors)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values())) > 0.97
    edges = spark.range(5000).select(F.col("id").alias("node"), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("neighbour"))
    few = N._few(edges, "neighbour", F.xxhash64("node"), 40)
    assert few.where("neighbour = 7").count() == 40 and few.count() == 90
    assert few._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2  # one before the shuffle


def test_very_long_texts(spark):
    """A text of a megabyte and more, with copies of it and of its passages: operators 1, 3, 5 and 10 against plain versions."""
    from pyspark.sql import functions as F

    from tests.llm import brute
    from transitlake.llm.decontaminate import decontaminate
    from transitlake.llm.neardup import near_duplicates
    from transitlake.llm.packing import pack
    from transitlake.llm.repeats import remove_repeats

    tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(6)
    words = [f"{rng.choice('abcdefgh')}{i}" for i in range(30_000)]
    long = " ".join(rng.choice(words) for _ in range(190_000))
    parts = long.split()
    docs = [(1, long), (2, " ".join([*parts[:-40], *["new"] * 40])), (3, " ".join(parts[90_000:90_060])), (4, long), (5, "short text"), (6, None)]
    assert len(long) > 1_000_000
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = [(1, " ".join(parts[150_000:150_020])), (2, "short text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = lambda df, *columns: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert told(decontaminate(df, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.decontaminate(docs, items), key=str)
    assert told(near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs), key=str)
    kept = remove_repeats(df).withColumn("kept_sha256", F.sha2("kept_text", 256))
    assert told(kept, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeats(docs), key=str)
    path = tokenizers.path("word_bpe_49k.json")
    assert told(pack(df, path), "doc_id", "piece", "start", "length", "ids_crc32") == sorted(brute.pieces(docs, path), key=str)
