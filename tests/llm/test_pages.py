"""URL rules, wrappers and licence scan against brute force and written cases."""

import math
import random
import re
from collections import Counter

import pytest

from casemill.llm import licenses, urlrules, wrappers


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def brute_rule(host, path, rules):
    fits = [(h + p, h, a) for h, p, a in rules if None not in (h, p, a) and (h == "" or ("." + host).endswith("." + h)) and path.startswith(p)]
    if not fits:
        return None, "allow"
    text, host, _ = max(fits, key=lambda r: (len(r[0]), len(r[1])))
    return text, "block" if any(a == "block" for t, h, a in fits if (t, h) == (text, host)) else "allow"


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_url_rules(spark, partitions):
    rng = random.Random(8)
    labels = ["a", "b", "ab", "net", "org", "é", "x-y"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))

    def path():
        return "".join("/" + rng.choice(["", "en", "e", "de", "x"]) for _ in range(rng.randint(0, 3)))

    urls = [f"https://{host()}{path()}{rng.choice(['', '?q=/en', '#/de'])}" for _ in range(300)] + ["HTTP://WWW.A.NET/EN/"] * 40
    urls += [None, "", "no scheme", "://", "x://", "http://a..net/", "http://net?u=http://org/", "ftp://ÀB.net/en/é", "http://-net/", "http://.net/"]
    rules = list({(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)}) + [("net", "/", "block"), ("net", "/", "allow"), ("", "/en", "block"), (None, "/", "block")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0]), (3, urls[3])], "page_id long, url string").selectExpr("*", "'k' AS key", "'r' AS rule")
        given = spark.createDataFrame(rules, "host string, path string, action string")
        got = sorted(urlrules.judge(pages, given).collect(), key=str)
        want = [(i, *split_url(u), *brute_rule(*split_url(u), rules)) for i, u in [*enumerate(urls), (None, urls[0]), (3, urls[3])]]
        assert got == sorted(want, key=str)
        none = urlrules.judge(pages, given.limit(0)).collect()
        assert len(none) == len(urls) + 2 and {(r.rule, r.verdict) for r in none} == {(None, "allow")}
        assert urlrules.judge(pages.limit(0), given).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


PAGE = ("<html><head><title>t</title><style>p{}</style><script>var x='</p>';</script></head><body><header>site</header><nav><ul><li>one<li>two</ul></nav>"
        "<div class='ad'>buy</div><article><header><h1>Big &amp; news</h1></header>{body}<aside>see also</aside><form>mail <input></form>"
        "<div id='comments-3'><p>first!</p></div></article><div class='sidebar'>side</div><footer>&copy; x</footer></body></html>")


@pytest.mark.parametrize("body, want", [
    ("<p>one <b>bo</b>ld</p><p>two", "Big & news one bold two"),
    ("<p>a<br>b<p>c &lt; d &#233;&nbsp; e", "Big & news a b c < d é e"),
    ("<!-- <p>no</p> --><p title=\"x>y\">kept</p><table><tr><td>1<td>2</table>", "Big & news kept 1 2"),
    ("<ul><li>x<li>y</ul>3 < 4 <div class=\"notice\">cookies</div>", "Big & news x y 3 < 4"),
    ("", "Big & news"),
    ("<p style='display: none'>no</p><div hidden>no</div><div class='text-with-sidebar'><p>kept</p></div><section class=\"comments\"><article>no</article></section>", "Big & news kept"),
])
def test_article_of_one_page(body, want):
    page = PAGE.replace("{body}", body)
    wrapper = wrappers.merged([wrappers.render(wrappers.shape(page))])
    assert wrappers.main_text(page, wrappers.article_paths(wrapper)) == want


def test_alignment_makes_optional_and_repeated_groups():
    def shape(x):
        return wrappers.render(wrappers.shape(x))

    assert shape("<div><p>a<p>b<p>c</div>") == "(div(p+(#)))"
    assert wrappers.merged([shape("<div><h1>a</h1><p>b</div>"), shape("<div><p>b<p>c</div>"), shape("<div><h1>x</h1><ul><li>1</ul></div>")]) == "(div(h1?(#),p*(#),ul?(li(#))))"
    text = "(html(body(div.ad?(#),article(h1(#),p+(#),ul*(li+(#))))))"
    assert wrappers.render(wrappers.parse(text)) == text and wrappers.merged([text, text]) == text


def test_wrapper_finds_an_unmarked_article():
    pages = [f"<body><div class=menu><a>m</a></div><div><div><p>{i} a</p>{'<p>more</p>' * i}</div><div>x</div></div><div class=footer>f</div></body>" for i in range(3)]
    paths = wrappers.article_paths(wrappers.merged([wrappers.render(wrappers.shape(p)) for p in pages]))
    assert paths == ["body/div/div"]
    assert [wrappers.main_text(p, paths) for p in pages[:2]] == ["0 a x", "1 a more x"]


def test_comments_in_article_tags():
    page = ("<body class='single page'><div class='content-with-sidebar'><main class='no-sidebar'><article class='post'><h1>T</h1><p>x</p></article>"
            "<article class='comment'><p>c</p></article></main><div class='sidebar-right'>s</div></div></body>")
    wrapper = wrappers.merged([wrappers.render(wrappers.shape(page))])
    assert wrappers.main_text(page, wrappers.article_paths(wrapper)) == "T x"


def test_extract_pages(spark):
    page = PAGE.replace("{body}", "<p>text</p>")
    rows = [(1, "http://a.net/x", page), (2, "http://a.net/y", page), (2, "http://a.net/y", page), (3, None, page), (None, "http://b.net", "<p>lone"), (4, "http://a.net/z", None),
            (5, "bad", ""), (6, "http://a.net/w", "<<<>>" * 50), (7, "http://a.net/long", PAGE.replace("{body}", "<p>" + "word " * 20000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'w' AS wrapper", "'t' AS text")
    got = {(r.page_id, r.url): r for r in wrappers.extract(pages).collect()}
    assert wrappers.extract(pages).count() == len(rows)
    assert got[1, "http://a.net/x"].text == got[3, None].text == "Big & news text"
    assert got[None, "http://b.net"].text == "lone"
    assert got[4, "http://a.net/z"].text == got[5, "bad"].text == ""
    assert got[7, "http://a.net/long"].n_chars == len("Big & news ") + 20000 * 5 - 1
    assert wrappers.extract(pages.limit(0)).count() == 0


def brute_licence(text, whole, threshold):
    def terms(t):
        return re.findall(r"[a-z0-9+\-]+(?:\.[a-z0-9]+)*", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    given = [Counter(terms(t)) for _, t in licenses.TEMPLATES]
    df = Counter(t for c in given for t in c)
    n = len(given)

    def vector(counts):
        return {t: k * (math.log((1 + n) / (1 + df.get(t, 0))) + 1) for t, k in counts.items()}

    def length(v):
        return math.sqrt(sum(x * x for x in v.values()))

    best = []
    for offer in (text or "").split("\n") + ([text or ""] if whole else []):
        v = vector(Counter(terms(offer)))
        for (name, _), c in zip(licenses.TEMPLATES, given):
            w = vector(c)
            cosine = round(sum(v[t] * w[t] for t in v if t in w) / (length(v) * length(w)), 6) if v else 0
            if cosine >= threshold:
                best.append((cosine, name))
    return max(best, default=(None, None))


def test_licences(spark):
    mit = licenses.TEMPLATES[1][1]
    rows = [(1, "p/LICENSE", mit), (2, "p/a/b/x.py", "code"), (3, "p/a/LICENSE.txt", "intro\nLicensed under the Apache License, Version 2.0\nmore"), (4, "q/x.py", "no\nunder licence of nobody"),
            (5, "p/a/y.py", "# Released under the MIT License.\ncode"), (6, None, "x"), (7, "top.py", None), (8, "p/z.py", ""), (8, "p/z.py", ""), (None, "p/c/w.py", "Licensed under CC BY-NC 4.0."),
            (9, "p/a/COPYING", "x " * 20000), (10, "license_tools/x.py", "LICENSE license licensing"),
            (11, "r/x.py", "code\nAll rights reserved.\nmore"), (12, "r/y.py", "[ALL] éRIGHTS, a..reserved"), (13, "r/z.py", "the under and of a to any"), (14, "r/w.py", "CC0 1.0; public domain")]
    files = spark.createDataFrame(rows, "file long, path string, text string").selectExpr("*", "'l' AS licence", "1 AS cosine", "'t' AS term")
    got = {r.file: (r.licence, r.cosine, r.from_path) for r in licenses.scan(files, licenses.templates(spark)).collect()}
    assert licenses.scan(files, licenses.templates(spark)).count() == len(rows)
    for i, path, text in rows:
        cosine, name = brute_licence(text, bool(path) and bool(re.match(licenses.LICENCE_FILE, path.split("/")[-1])), 0.7)
        if i is not None and name:
            assert got[i] == (name, cosine, None)
        elif i is not None:
            assert got[i][1] is None
    assert got[1][0] == "MIT" and got[2] == ("Apache-2.0", None, "p/a") and got[5][0] == "MIT" and got[8] == ("MIT", None, "p") and got[9] == ("Apache-2.0", None, "p/a")
    assert got[11][0] == got[12][0] == "proprietary" and got[14][0] == "CC0-1.0"
    assert got[4] == got[6] == got[7] == got[10] == (None, None, None)
    assert licenses.scan(files.limit(0), licenses.templates(spark)).count() == 0


@pytest.mark.parametrize("body, want", [
    ("<main style='overflow: hidden' class='overflow-hidden' aria-hidden='false'><article class='x-hidden'><p>seen</p></article></main>", "seen"),
    ("<article><h2 id='related-work'>Related work</h2><section id='search'><p class='alert'>found</p></section><div class='side-effects'>none</div></article>", "Related work found none"),
    ("<article><p>a</p><div aria-hidden='true'>b</div><div class='share'>c</div><p hidden>d</p><section id='comments'>e</section></article>", "a"),
])
def test_hidden_and_names_in_an_article(body, want):
    page = f"<body class='overflow-hidden'>{body}</body>"
    assert wrappers.main_text(page, wrappers.article_paths(wrappers.merged([wrappers.render(wrappers.shape(page))]))) == want


@pytest.mark.parametrize("body, want", [
    ("<div class='post-meta'>date</div><div class='post-text'>article</div>", "date article"),
    ("<section class='story-rest'>one</section><section class='story-intro'>two</section>", "one two"),
    ("<nav>n</nav><div class='left'><p>one</p></div><div class='right'><p>two</p><p>three</p></div><div class='my-footer'>f</div>", "one two three"),
    ("<main><header>site</header><article><header>T</header><p>x</p></article><p>rest</p></main>", "T x rest"),
])
def test_all_containers_of_an_article(body, want):
    page = f"<body><header>site</header>{body}</body>"
    assert wrappers.main_text(page, wrappers.article_paths(wrappers.merged([wrappers.render(wrappers.shape(page))]))) == want
