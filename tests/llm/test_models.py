import itertools
import time
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerotrace.llm import html_text, line_crf, queries, toxicity, url_filter
from aerotrace.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, half int, out string"


def rows(texts):
    return [(i, t, "en", "s", 0, 0.0, 0, 0, "") for i, t in texts]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    unary, pair, count = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([4, 1, 2])
    p, pairs, logz = line_crf.marginals(unary, pair, count)
    at, want_pairs = 0, np.zeros((2, 2))
    for c, z in zip(count, logz, strict=True):
        u, total, per = unary[at:at + c], 0.0, np.zeros(c)
        for y in itertools.product((0, 1), repeat=int(c)):
            w = np.exp(sum(u[i] * y[i] for i in range(c)) + sum(pair[a, b] for a, b in itertools.pairwise(y)))
            total += w
            per += w * np.array(y)
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += w / np.exp(z)
        assert np.isclose(np.log(total), z) and np.allclose(p[at:at + c], per / total)
        at += c
    assert np.allclose(pairs, want_pairs)


def test_line_features_of_odd_texts():
    texts = ["", "\n", "a\n\nb b b", "", "x" * 100_000, "é|é"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t.encode()) for t in texts])
    start = np.concatenate(([0], end[:-1]))
    lines = line_crf.line_features(raw, start, end)
    assert lines.count.tolist() == [1, 2, 3, 1, 1, 1] and lines.size.tolist() == [0, 0, 0, 1, 0, 5, 0, 100_000, 5]
    assert np.isfinite(lines.x).all() and lines.x[5, 11] == 1.0


def corpus(n=600, seed=3):
    rng, docs, labels = random.Random(seed), [], []
    word = lambda: "".join(rng.choice(("th", "an", "er", "ing", "on", "re", "es")) for _ in range(rng.randrange(1, 4)))
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randrange(4, 14))) + "." for _ in range(rng.randrange(1, 6))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.25
        if toxic:
            w = rng.choice(("idiot", "moron", "scum"))
            at = rng.randrange(len(lines))
            lines[at] = f"{w} {lines[at]}" if not bad else lines[at] + f" {w}"
        if bad:
            lines = [" ".join(x + "###" for x in line.split()) for line in lines]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    extra = [(10_000, None), (10_001, ""), (10_002, " \n "), (10_003, "an er " * 30_000), (0, docs[0][1])]
    df = spark.createDataFrame(rows(docs + extra), DOCS).repartition(4)
    lf = spark.createDataFrame([*labels, (5, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    return df, lf, labels


def check(scored, labels, at, least):
    got = {r["doc_id"]: r["score"] for r in scored}
    assert all(0 <= s <= 1 for s in got.values()) and len(scored) == 605
    right = [(got[i] >= 0.5) == bool(y) for i, *ys in labels for y in [ys[at]]]
    assert np.mean(right) >= least


def test_quality(learned):
    df, lf, labels = learned
    scored = line_crf.score(df, line_crf.fit(df, lf, ~held_out())).collect()
    check(scored, labels, 0, 0.97)
    with_all = line_crf.score(df, None, tuple(df.columns), "mark")
    assert with_all.columns == [*df.columns, "mark"] and {r["mark"] for r in with_all.collect()} == {0.5}


def test_toxicity(learned):
    df, lf, labels = learned
    model = toxicity.fit(df, lf, ~held_out())
    check(toxicity.score(df, model).collect(), labels, 1, 0.97)
    reader = toxicity.Reader(model.evidence, model.letters)
    for disguised in ("1d10t", "i.d.i.o.t", "idiiiiot", "M0R0N!!", "m-o-r-o-n", "s c u m", "sc um", "$cum", "scuuuum###"):
        assert reader.text("an er ing " + disguised + " on re")[0] > toxicity.STRONG, disguised
    assert not [e for e in reader.text("an er ing on 1999 a b c d 10.5 3rd") if e > 1]


@pytest.fixture(scope="module")
def reader(learned):
    model = toxicity.fit(learned[0], learned[1], ~held_out())
    return toxicity.Reader(model.evidence, model.letters)


def test_disguised_words_beside_others(reader):
    for disguised in ("a s c u m", "o n e r i d i o t a n", "th a i d i o t", "on.Idiot", "ering-1diot", "scum-an"):
        assert max(reader.text("an er ing " + disguised + " on re"), default=0) > toxicity.STRONG, disguised
    assert sum(e > toxicity.STRONG for e in reader.text("i d i o t o n s c u m")) == 2
    assert not [e for e in reader.text("an er.ing on-re th e r e a n") if e > 1]


def test_disguised_words_far_into_a_run(reader, spark):
    for disguised in ("i" + 70 * "d" + "iot", 70 * "1" + "diot", 100 * "on " + "x", " ".join("oner" * 30 + "idiot"), "-".join(["oning"] * 20) + "-1d10t"):
        found = max(reader.text("an er ing " + disguised + " on re"), default=0)
        assert (found > toxicity.STRONG) == (disguised[-1] != "x"), disguised
    long = "scum" * 40
    counts, _ = toxicity.term_counts(spark.createDataFrame([(0, 1, long)], "half int, label int, text string"))
    assert "=" + long in {r["term"] for r in counts.collect()}
    known = toxicity.Reader({"=" + long: 3.0}, reader.letters)
    assert known.text(long[:100] + " " + long[100:]) == [3.0] and known.text(long) == [3.0] and not known.head(long[:-1])


def test_doubled_letters(reader):
    for disguised in ("iddiot", "ssccuumm", "mmoron", "moroon", "scuum", "Iidioott."):
        assert max(reader.text("an er ing " + disguised + " on re"), default=0) > toxicity.STRONG, disguised
    assert not [e for e in reader.text("onn erring thhan eess") if e > 1]


def test_models_without_labels(learned, spark):
    df, lf, _ = learned
    none = lf.filter("doc_id < 0")
    assert line_crf.fit(df, none, ~held_out()) is None and toxicity.fit(df, none, ~held_out()) is None
    empty = spark.createDataFrame([], DOCS)
    assert line_crf.score(empty, None).collect() == [] == toxicity.score(empty, None).collect()
    assert line_crf.fit(empty, lf, ~held_out()) is None and toxicity.fit(empty, lf, ~held_out()) is None


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><div class="cookie-notice">We use cookies here.</div>
<article><h1>Head &amp; line</h1><p>First <b>para</b>graph of the text, which is long enough to count as content.<p>No.<br>Second line of it,
  with&nbsp;spaces.</p><div class="ad">Buy now, buy more, buy it all today!</div><form>Sign up <input></form><p>Third paragraph that closes the article, also long.</p></article>
<aside>Related things to read</aside><div id="comments"><p>I liked this article so much that I wrote a long comment on it.</p></div><footer>&copy; Nobody</footer><script>x="</p>"</script></body></html>"""
TEXT = ("Head & line First paragraph of the text, which is long enough to count as content. No. Second line of it, with spaces. "
        "Third paragraph that closes the article, also long.")


def test_main_text(spark):
    assert html_text.main_text(PAGE) == TEXT
    flat = PAGE.replace("<article>", '<div class="post-body">').replace("</article>", "</div>")
    assert html_text.main_text(flat) == TEXT
    assert html_text.main_text(PAGE.replace("\n", " " * html_text.FEED + "\n")) == TEXT
    odd = {None: "", "": "", "<": "<", "plain": "plain", "<nav>menu</nav>": "", "<p>a</p><p>b": "a b", "<!-- x --><b>c</b>d": "cd", "&lt;&#233;&bogus;": "<é&bogus;"}
    assert {h: html_text.main_text(h) for h in odd} == odd
    df = spark.createDataFrame([(i, "u", h, "x", 9) for i, h in enumerate([*odd, PAGE, PAGE])], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(df).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [*odd.values(), TEXT, TEXT] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.filter("page_id < 0")).collect() == []


TEMPLATES = ["content with-sidebar", "post share", "main-content header-fixed", "entry-content tags", "page--related", "article-with-comments", "col-md-8 has-widgets", "post-single nav-below",
             "site-inner sidebar-right", "blog-post promoted subscribe", "story share-bar-left", "post type-post tag-news", "layout--ad-free", "page-banner-none", "wrapper cookie-accepted", "menu-open site",
             "content recommended", "td-post-content tagdiv-type sponsor", "post_header_standard", "no-footer-margin main"]


@pytest.mark.parametrize("name", TEMPLATES)
def test_names_around_the_article_do_not_remove_it(name):
    body = PAGE[PAGE.index("<article>"):PAGE.index("</article>") + 10]
    plain = body.replace("<article>", "").replace("</article>", "")
    bare = plain.replace("<h1>", "<p>").replace("</h1>", "</p>")
    for inner in (body, plain):
        for around in (f'<div class="{name}">{inner}</div>', f'<div id="x"><section class="{name}"><div>{inner}</div></section></div>'):
            assert html_text.main_text(PAGE.replace(body, around)) == TEXT
    if "comments" not in name:
        assert html_text.main_text(PAGE.replace(body, f'<div class="{name}">{bare}</div>')) == TEXT


def test_lists_of_links_in_an_article_and_long_comments():
    links = "<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li><li><a href=/3>Third source</a></li></ul></article>"
    assert html_text.main_text(PAGE.replace("</article>", links)) == TEXT + " First source Second source Third source"
    assert html_text.main_text(PAGE.replace("<aside>", links.replace("</article>", "<aside>"))) == TEXT
    many = "".join(f'<li><article class="comment-body"><p>Reader {i} writes at length about all that the article says, and more.</p></article></li>' for i in range(40))
    assert html_text.main_text(PAGE.replace('<div id="comments">', f'<div id="comments">{many}')) == TEXT
    assert html_text.main_text(PAGE.replace("Head &amp; line", '<span class="header-text">Head &amp; line</span><span class="ad">Buy</span>')) == TEXT
    assert html_text.main_text('<article><h1></h1></article><div class="ad">Buy now, buy more, buy it all today!</div>') == ""


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<b>" * 50_000 + "<div>y</div>" * 50_000, "<div>x</p>" * 60_000, "<ul><li>z" * 50_000, " <i> </i>" * 60_000 + "x", '<div class="ad share">w' * 50_000])
def test_broken_pages_take_time_by_length_only(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 20


def test_page_texts_equal_their_documents(spark, tables):
    """The invented pages hold documents, which their urls name."""
    pages = html_text.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in pages.collect():
        body = " ".join(docs[int(r["url"].split("://")[1].split("/")[2].split("?")[0].split("#")[0].split(".")[0])].split())
        assert r["text"].replace(" ", "").endswith(body.replace(" ", ""))


URLS = [(0, "http://A.Example.org/es/1"), (1, "https://example.org/en/12?x"), (2, "https://example.org/en/2#y"), (3, "http://x.com/fr/"), (4, "HTTP://x.com/de/1"), (5, "http://notorg/"),
        (6, None), (7, "no scheme/de/"), (8, "https://org"), (9, "x://org/?q"), (10, ""), (11, "http://free-bets.example.net/en/5"), (12, "http://museum.example.net/en/5"), (12, "http://museum.example.net/en/5")]


def test_url_rules_and_model(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in URLS], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, queries.URL_RULES, url_filter.train(queries.labelled_urls(spark))).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/en/2", "org/", "allow") and got[3] == ("x.com", "/fr/", "com/fr/", "allow") and got[4] == ("x.com", "/de/1", "com/de/", "block")
    assert got[5][:3] == ("notorg", "/", None) and got[6] == got[7] == got[10] == ("", "", None, "allow")
    assert got[8][:3] == ("org", "", None) and got[9][:3] == ("org", "/", "org/")
    assert got[11][2:] == (None, "block") and got[12][2:] == (None, "allow")
    assert url_filter.judge(df.filter(F.col("page_id") < 0), queries.URL_RULES, url_filter.train(queries.labelled_urls(spark))).count() == 0
    with pytest.raises(ValueError):
        url_filter.train(queries.labelled_urls(spark).filter("label = 0"))

def test_url_words_held_out(spark):
    """Every fifth word is kept from the fit: ordinary ones are let through; unwanted ones are only known by the n-grams they share with others."""
    rows = queries.labelled_urls(spark).collect()
    model = url_filter.train(spark.createDataFrame([r for i, r in enumerate(rows) if i // 4 % 5]))
    host_path = spark.createDataFrame(rows).select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"), "label").collect()
    blocked = [(i // 4 % 5 == 0, r["label"], model.probability(r["h"], r["p"]) >= 0.5) for i, r in enumerate(host_path)]
    share = lambda out, label: np.mean([b for o, y, b in blocked if (o, y) == (out, label)])
    assert share(False, 1) > 0.98 and share(False, 0) < 0.02 and share(True, 0) < 0.1


def test_url_regression_equals_a_plain_one(spark):
    """The gradient of the loss, summed row by row, vanishes at the fitted weights."""
    rows = queries.labelled_urls(spark).collect()[::9]
    model = url_filter.train(spark.createDataFrame(rows), bits=12, l2=1e-2, rounds=3000, rate=0.2, prior=0.5)
    y, grad = np.array([r["label"] for r in rows]), 1e-2 * model.weights
    for (u, label) in rows:
        rest = u.split("://")[1]
        at = url_filter.slots_of(rest.partition("/")[0], ("/" + rest.partition("/")[2]).split("?")[0], 12)
        z = model.bias + model.weights[at].sum() / np.sqrt(len(at))
        grad[at] += 0.5 / (y == label).sum() * (1 / (1 + np.exp(-z)) - label) / np.sqrt(len(at))
    assert np.abs(grad).max() < 2e-3
