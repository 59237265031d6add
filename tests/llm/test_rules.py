"""Quality rules, mixing, URL filters and HTML extraction."""

import html as h
import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from wickerframe.llm.html_extract import extract, main_text
from wickerframe.llm.mixing import mix, targets
from wickerframe.llm.quality_rules import quality_rules
from wickerframe.llm.url_filter import RULES, filter_urls, rules_frame

GOOD = "The cat sat on the mat and looked at the rain that fell on the garden all day long without an end in sight."


def literal_counts(text):
    w = brute.words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, prose):
    cycle = " ".join("abcdefghijkl") + " "
    texts = [t for _, t in prose] + [GOOD, cycle * 3, cycle + GOOD + " " + cycle, "aa " * 40, GOOD + "\n" + GOOD + "\nx\nx\n x", "Home | About | Contact | News\n" * 6 + GOOD, "# * $ % & | < > a" * 9, "LOUD!! WORDS!! " * 30, "Read more\n" + GOOD]
    df = spark.createDataFrame([(i, t, 1, "x", ["y"]) for i, t in enumerate(texts)], "doc_id long, text string, n_words long, t string, lines array<string>")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == literal_counts(t), t
        assert not (r.kept and r.base_failed)
    by = {t: got[i] for i, t in enumerate(texts)}
    assert by[GOOD].kept and by["Read more\n" + GOOD].clean_text == GOOD and by["Read more\n" + GOOD].kept
    assert not by["Home | About | Contact | News\n" * 6 + GOOD].kept and not by["LOUD!! WORDS!! " * 30].kept
    nulls = spark.createDataFrame([(None, None), (1, GOOD), (1, GOOD)], "doc_id long, text string")
    assert sorted(r.kept for r in quality_rules(nulls).collect()) == [False, True, True]
    assert quality_rules(nulls.limit(0)).count() == 0


def test_quality_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in got.where(~F.col("base_failed")).groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts.get((0, True), 0) == 0


def sources(prose):
    names = ["b", "a", None, "Z", "é", "hot"]
    return [(d, t, names[i % 6] if i % 2 else "hot") for i, (d, t) in enumerate(prose)] + [(5000, None, "nothing"), (5001, "", "nothing"), (None, "w " * 30, "a"), (1, prose[0][1], "hot")]


@pytest.mark.parametrize("cut_last", [True, False])
def test_mixing(spark, prose, cut_last):
    rows = sources(prose)
    df = spark.createDataFrame([(*r, 9, 0.5) for r in rows], "doc_id long, text string, source string, size long, key double").repartition(3)
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix(df, cut_last=cut_last).collect()), key=repr)
    want = sorted(((d[0], n, total, round(goal, 6), taken) for d, (n, total, goal, taken) in zip(rows, brute.mix(rows, cut_last))), key=repr)
    assert got == want
    assert all(taken <= 2 * n for _, n, _, _, taken in got)
    if cut_last:
        for s in {r[2] for r in rows}:
            own = [x for r, x in zip(rows, brute.mix(rows)) if r[2] == s]
            assert abs(sum(x[3] for x in own) - own[0][2]) <= 0.5
    assert sorted(map(tuple, mix(df, cut_last=cut_last).collect()), key=repr) == sorted(map(tuple, mix(df.repartition(5), cut_last=cut_last).collect()), key=repr)


def test_mixing_buckets(spark, monkeypatch):
    from wickerframe.llm import mixing as m

    monkeypatch.setattr(m, "BUCKET_ROWS", 7)
    rows = [(i, "word " * (i % 9 + 1), "s0" if i % 3 else "s1") for i in range(400)]
    got = {r.doc_id: r.taken for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {d[0]: x[3] for d, x in zip(rows, brute.mix(rows))}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, "d": 100}, {"a": 0, "b": 3}, {"x": 7}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in targets(df).collect()}
        want = brute.level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5)
        assert got == pytest.approx(want)
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def literal_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(rh + rp), len(rh), v, rh + rp) for v, rh, rp in rules if (host == rh or host.endswith("." + rh)) and path.startswith(rp)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_filter(spark):
    urls = [
        "http://example.org/es/1", "https://a.b.example.org/en/199?x#y", "https://example.org/en/2", "http://ORG/", "http://org", "http://x.com/de/1", "http://x.com/fr/1", "http://notexample.org/es/", "http://example.org.evil.net/es/",
        "no scheme", "", None, "://", "a://b://c/d", "http://x.com?/de/", "http://x.com#/de/", "http://x.com/de", "http://user@x.com:80/de/", "http://x.com:80/de/", "http://.org/x", "http://org./x", "http://a.é.org/ü", "//x.com/de/", "http://x.com/de/\n", "http://x.net/" + "p/" * 3000,
    ] * 2
    df = spark.createDataFrame([(i if i % 9 else None, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    got = sorted(map(tuple, filter_urls(df, rules_frame(spark)).collect()), key=repr)
    assert got == sorted(((i if i % 9 else None, *literal_verdict(u, RULES)) for i, u in enumerate(urls)), key=repr)
    more = [("block", "com", "/"), ("allow", "com", "/"), ("allow", "x.com", ""), ("block", None, "/")]
    got = {r.path: (r.rule, r.verdict) for r in filter_urls(spark.createDataFrame([(1, "http://x.com/a"), (2, "http://y.com/b")], "page_id long, url string"), rules_frame(spark, more)).collect()}
    assert got == {"/a": ("x.com", "allow"), "/b": ("com/", "block")}
    none = filter_urls(df, rules_frame(spark, []), default="block")
    assert none.where("verdict != 'block' or rule is not null").count() == 0
    assert filter_urls(df.limit(0), rules_frame(spark)).count() == 0


def test_url_filter_many_labels(spark):
    """Hosts of a hundred thousand labels; rules in capitals, and with a capital that is not A to Z."""
    rules = [*RULES, ("block", "EXAMPLE.net", "/"), ("block", "Éx.org", "/")]
    urls = ["http://" + "a." * 100_000 + "example.org/es/1", "http://" + "a." * 100_000 + "org/", "http://x.EXAMPLE.NET/", "http://Éx.org/", "http://éx.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, rules_frame(spark, rules)).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("org/", "allow"), 2: ("example.net/", "block"), 3: ("Éx.org/", "block"), 4: ("org/", "allow")}


def test_mixing_weights(spark):
    """A column of scores: heavier documents come first; what is no positive number hardly comes at all."""
    rows = [(i, "word " * 10, "s", [50.0, 1.0, None, -1.0, float("nan")][i % 5]) for i in range(1000)] + [(5000 + i, "w", f"t{i}", 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    got = mix(df, weight_col="quality", weights=(1.0,), total=0.5).toPandas()
    own = got[got.doc_id < 1000]
    taken = own.groupby(own.doc_id % 5).taken.sum() / own.groupby(own.doc_id % 5)["size"].sum()
    assert taken[0] > 0.97 and taken[1] > 0.9 and max(taken[2:5]) < 0.3
    assert own.taken.sum() == pytest.approx(own.target.iloc[0], abs=0.5)


def literal_line_fails(line):
    """The line rules, by words."""
    from wickerframe.llm import quality_rules as q

    w = brute.words(line)
    n = len(w)
    closed = any(re.fullmatch(r"""(?s).*[.!?…:;]["'”’»)\]]*""", x) for x in w)
    symbols = sum(c in "#*$%&|<>" for c in line)
    shouted = sum(re.fullmatch(r"[A-ZÀ-ÖØ-Þ]{2,}[^a-zA-ZÀ-ÿ]*!", x) is not None for x in w)
    stutter = sum(a == b for a, b in zip(w, w[1:]))
    capitals = sum(x[0].isupper() for x in w)
    phrase = n <= 25 and any(p in line.lower() for p in q.BOILERPLATE)
    return symbols > 0.3 * n or (n >= 5 and shouted > 0.6 * n) or (n >= 10 and stutter > 0.4 * n) or phrase or (not closed and (n >= 8 or (3 <= n <= 12 and capitals == n)))


def test_quality_lines(spark):
    """Line rules against their literal form, menus and furniture in four languages, and lines of the tables."""
    lines = ["Home Products About Contact", "Accueil Produits Contact Boutique", "Tous droits réservés 2020", "Alle Rechte vorbehalten", "Política de privacidad", "Datenschutzerklärung", "One two three four five six seven eight", "One two three four five six seven eight.", 'He said "no."', "Home", "The Great Gatsby", "The Great Gatsby.", "a b", "A B C:", "(Yes!) and NO!! NO!! WAY!! GO!! ON!!", "été Été ÉTÉ!! ÉTÉ!! ÉTÉ!! ÉTÉ!! ÉTÉ!!", "x x x x x x x x x x.", "1 2 3 4 5 6 7 8"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines += [x for r in docs.collect() for x in (r.text or "").split("\n") if brute.words(x)]
    from wickerframe.llm.quality_rules import line_fails

    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string")
    got = {r.i: r.f for r in df.select("i", line_fails(F.col("line")).alias("f")).collect()}
    assert [x for i, x in enumerate(lines) if got[i] != literal_line_fails(x)] == []
    assert [got[i] for i in range(10)] == [True] * 7 + [False, False, False]


SENTENCE = "It was the best of times for the people of the town, and it was not the worst of times for the others who had been there with us."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>" + SENTENCE, SENTENCE),
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One<br>two &amp; t&eacute;&#39;s</p><footer>by me</footer></article><footer>&copy; x</footer>", "Title One two & té's"),
        (f"<div id=top class='main-menu'><a>A</a> | <a>B</a></div><div><p>{SENTENCE}</p><p>Short.</p><p>{SENTENCE}</p></div><div class=cookie-banner>{SENTENCE}</div>", f"{SENTENCE} Short. {SENTENCE}"),
        (f"<body><p>{SENTENCE}</p><h2>Comments</h2><div><p>{SENTENCE}</p></div>", SENTENCE),
        (f"<p>{SENTENCE}</p><form>{SENTENCE}<input></form><aside>{SENTENCE}</aside><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- {SENTENCE} -->", SENTENCE),
        (f"<p>{SENTENCE}</p><ul><li><a href=x>{SENTENCE}</a></li></ul>", SENTENCE),
        (f"<article><p>{SENTENCE}</p><div class='comment-list'><p>{SENTENCE}</p></div></article>", SENTENCE),
        (f"<div class='site-header'>{SENTENCE}</div><div class='article-body'><p>Zzz zzz qqq xx yy ww vv uu tt ss rr pp oo.</p></div><div id=sideNav>{SENTENCE}</div>", "Zzz zzz qqq xx yy ww vv uu tt ss rr pp oo."),
        (f"<div class='post'><p>{SENTENCE}</p></div><section class=userComments><p>{SENTENCE}</p></section><div class=notice>{SENTENCE}</div>", SENTENCE),
        ("<article><p>a < b and c <d", "a < b and c"),
        ("<p>" * 3000 + "x", "x"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("attribute", ["href='/hidden-gems'", "title='The hidden valley'", 'data-hidden="false"', 'href="/p?id=menu"', "data-class=menu", "title='a class=menu'", "alt='role=alert' x"])
def test_attribute_values_are_not_names(attribute):
    for tag in ("a", "p", "h1", "div"):
        assert "the river" in main_text(f"<article><p>{SENTENCE}</p><p>It runs along <{tag} {attribute}>the river</{tag}> to the sea.</p></article>")


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN=''", "x=1 hidden", "style='color:red;display: none'", "role=alert", 'title="x" class="menu"', "aria-hidden=true", "id='menu' id='x'"])
def test_excluding_attributes(attribute):
    assert main_text(f"<article><p>{SENTENCE}</p><div {attribute}>{SENTENCE}</div></article>") == SENTENCE


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<h1>Comment fonctionne le vaccin ?</h1><p>{SENTENCE}</p>", f"Comment fonctionne le vaccin ? {SENTENCE}"),
        (f"<article><h1>Comment fonctionne le vaccin ?</h1><p>{SENTENCE}</p></article>", f"Comment fonctionne le vaccin ? {SENTENCE}"),
        (f"<article><p>12 Comments</p><p>{SENTENCE}</p><p>No comment.</p><p>{SENTENCE}</p></article>", f"12 Comments {SENTENCE} No comment. {SENTENCE}"),
        (f"<article><h2>Responses</h2><p>{SENTENCE}</p></article>", f"Responses {SENTENCE}"),
        (f"<p>{SENTENCE}</p><p>No comment.</p><p>{SENTENCE}</p>", f"{SENTENCE} No comment. {SENTENCE}"),
        (f"<p>{SENTENCE}</p><h2>Replies from the ministry</h2><p>{SENTENCE}</p>", f"{SENTENCE} Replies from the ministry {SENTENCE}"),
        (f"<p>{SENTENCE}</p><div><h3>Comments (12)</h3><p>{SENTENCE}</p></div><p>It was the end.</p><p>{SENTENCE}</p>", f"{SENTENCE} It was the end. {SENTENCE}"),
        (f"<div><p>{SENTENCE}</p><h3><span>3</span> Kommentare</h3><div><p>{SENTENCE}</p></div></div>", SENTENCE),
        (f"<p>{SENTENCE}</p><h3>Leave a comment</h3><p>{SENTENCE}</p>", SENTENCE),
    ],
)
def test_comment_titles(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='has-sidebar'><p>{SENTENCE}</p></div>", SENTENCE),
        (f"<div class='has-sidebar'><article><p>{SENTENCE}</p></article><div class=sidebar><p>{SENTENCE}</p></div></div>", SENTENCE),
        (f"<div id='content-sidebar-wrap'><main><p>{SENTENCE}</p></main><aside>{SENTENCE}</aside></div>", SENTENCE),
        (f"<div id='content-sidebar-wrap'><div class=content><p>{SENTENCE}</p><p>{SENTENCE}</p></div><div class=sidebar-right>{SENTENCE}</div></div>", f"{SENTENCE} {SENTENCE}"),
        (f"<article class='post category-social tag-search'><p>{SENTENCE}</p></article>", SENTENCE),
        (f"<article class='post category-social social-post'><h1>Title</h1><p>{SENTENCE}</p><div class='share-links'>{SENTENCE}</div></article>", f"Title {SENTENCE}"),
        (f"<div class='widget-area'><div class='menu-layout'><article><p>{SENTENCE}</p></article></div></div>", SENTENCE),
        (f"<article><p>{SENTENCE}</p></article><div class=related><article><p>{SENTENCE}</p><p>{SENTENCE}</p></article></div>", SENTENCE),
        (f"<div class=content><p>{SENTENCE}</p></div><div id=comments><article class='comment-body'><p>{SENTENCE}</p><p>{SENTENCE}</p></article></div>", SENTENCE),
        (f"<p>{SENTENCE}</p><div class=sidebar><article><p>Read on here.</p></article></div>", SENTENCE),
        (f"<div class='cookie-banner'><p>{SENTENCE}</p></div>", ""),
    ],
)
def test_named_wrappers(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("element", ["<div class='layout has-sidebar'><article>{}</article></div>", "<div class='bg-navy'>{}</div>", "<p class='commentary'>{}</p>", "<p data-id='share-1'>{}</p>", "<div class='no-sidebar with-menu'>{}</div>", "<div class=navajo>{}</div>", "<section class='text-comment menuhin'>{}</section>"])
def test_names_are_whole_words(element):
    assert main_text("<nav><a href=/>Home</a> <a href=/x>Other</a></nav>" + element.format(SENTENCE) + "<footer>&copy; x</footer>") == SENTENCE


def test_densities_decide_in_the_article():
    """Link lists go and short lines follow their neighbours, inside a marked article as well."""
    links = "<ul><li><a href=x>One thing</a></li><li><a href=y>Another thing to read</a></li></ul>"
    assert main_text(f"<article><p>{SENTENCE}</p>{links}<p>Short.</p><p>Odd wyrds xx yy zz qq ww ee rr tt uu ii oo pp.</p><p>{SENTENCE}</p></article>") == f"{SENTENCE} Short. Odd wyrds xx yy zz qq ww ee rr tt uu ii oo pp. {SENTENCE}"


def neutral(page):
    """The page without what its markup says of containers: only blocks, their words and links are left."""
    page = re.sub(r"<(/?)(?:nav|footer|article|header|aside|section|main)\b", r"<\1div", page)
    return re.sub(r"""\b(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_densities_alone(spark):
    """With every container a plain div the two passes find the same text on over nine pages of ten; the rest are
    articles of junk (menus, shouting, one word over and over) or open with a line that reads like the advert before."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = sum(main_text(p) == main_text(neutral(p)) for p in pages)
    assert same >= 0.92 * len(pages)


def test_long_page():
    many = "".join(f"<div class=x><p>{SENTENCE}</p><p>Short {i}.</p>" for i in range(4000))
    assert len(main_text("<body>" + many).split()) == 4000 * len(f"{SENTENCE} Short 1.".split())


def test_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in extract(pages).join(pages, "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())
        assert r.text == want and r.n_chars == len(want)
    odd = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "", "t")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in extract(odd).collect()] == [("", 0)] * 3
    assert extract(odd.limit(0)).count() == 0
