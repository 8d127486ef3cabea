"""Pages, links, listings and rulebook chunks on our own strings."""

import datetime
from urllib.parse import urljoin

from pyspark.sql import functions as F

from casemill.functions import rulebook as B
from casemill.functions import web
from casemill.operators import chunks as CH


def test_absolute_url_follows_the_standard(spark):
    base = "https://a.example.org/x/y/page?q=1#top"
    links = ["z.pdf", "/r/s", "//other.org/k", "?p=2", "#frag", "../up", "./same", "../../../over/./t", "mailto:x@y.z",
             "http://b.org/c d", "", "k/..", "a/b/../c?x=../y"]
    df = spark.createDataFrame([(u,) for u in links], "u string")
    got = {r.u: r.a for r in df.select("u", web.absolute_url(F.lit(base), F.col("u")).alias("a")).collect()}
    assert got == {u: urljoin(base, u) for u in links}


def test_page_text_and_entities(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><main><h1>A &amp; B</h1>"
            "<script>x</script><!-- no --><p> one <b>two</b> &#233;&#x2014;&nbsp;&copy; &bogus; </p></main><footer>f</footer></body></html>")
    row = spark.createDataFrame([(html,)], "h string").select(web.main_text(F.col("h")).alias("t"), web.page_title(F.col("h")).alias("i")).first()
    assert row.t == "A & B\none\ntwo\né—\xa0© &bogus;" and row.i == "A & B"
    bare = spark.createDataFrame([("<title>Only</title><p>x</p>",)], "h string").select(web.page_title(F.col("h"))).first()[0]
    assert bare == "Only"


def test_pdf_on_page(spark):
    html = '<a href="/q-quarterly-disciplinary.pdf">q</a><a href="/m.pdf">May Disiplinary list</a><a href="/n.pdf">disciplin</a>'
    got = spark.createDataFrame([(html,)], "h string").select(web.pdf_on_page(F.col("h"), F.lit("https://x.org/p"))).first()[0]
    assert got == "https://x.org/m.pdf"


def test_canonical_and_rule_links(spark):
    html = ("<a href='/index.php/rules-guidance/rulebooks/finra-rules/4511'>a</a><a href=\"https://X.org/rules-guidance/rulebooks/finra-rules/4511/\">b</a>"
            "<a href='/rules-guidance/rulebooks/finra-rules/IM-2210-1?x=1#y'>c</a><a href='/about'>d</a>")
    got = spark.createDataFrame([(html,)], "h string").select(web.rule_links(F.col("h"), F.lit("https://x.org/"))).first()[0]
    assert got == ["https://x.org/rules-guidance/rulebooks/finra-rules/4511", "https://x.org/rules-guidance/rulebooks/finra-rules/IM-2210-1"]


def test_listing(spark):
    html = ('<table><tr><th>x</th></tr><tr><td class="views-field views-field-field-fda-attachment-file-media"><a href="/held/1998123456709%20ruling.pdf">19981</a></td>'
            '<td class="views-field-views-conditional-field-3">North <i>Pier</i> Ltd</td>'
            '<td class="views-field-field-fda-document-type-tax">Order</td><td class="views-field-field-core-official-dt is-active">12/30/1999</td></tr>'
            '<tr><td class="views-field-field-fda-attachment-file-media"><a href="/held/y.pdf">20010 00000042</a></td></tr></table>')
    pages = spark.createDataFrame([(1, "https://x.org/l", html)], "page_id int, url string, html string")
    rows = {r.case_no: r for r in CH.listing_rows(pages).collect()}
    assert set(rows) == {"1998123456709", "2001000000042"}
    first = rows["1998123456709"]
    assert (first.doc_type, first.respondent, first.action_date) == ("Order", "North Pier Ltd", datetime.date(1999, 12, 30))
    assert rows["2001000000042"].doc_type is None and rows["2001000000042"].action_date is None


def test_rule_body(spark):
    def body(text, title):
        return spark.createDataFrame([(text, title)], "t string, i string").select(B.rule_body(F.col("t"), F.col("i"))).first()[0]
    assert body("Menu 10. Oath Home 10. Oath The Rule Guidance All must\n swear. Amended by SR-1 eff. x", "10. Oath") == "All must swear."
    assert body("Related Topics " + "word " * 60 + "Rulebook Search end", "absent title").endswith("word")
    assert body("10. Oath Selected Notice: 1", "10. Oath") == "Selected Notice: 1"
    assert body("Just text here ©", "") == "Just text here ©"


def test_windows_cover_every_word(spark):
    for n in (1, 7, 10, 11, 16, 17, 25, 100):
        text = " ".join(f"w{i}" for i in range(n))
        parts = spark.createDataFrame([(text,)], "t string").select(B.word_windows(F.col("t"), 10, 4)).first()[0]
        expected = [text] if n <= 10 else [" ".join(text.split()[i:i + 10]) for i in range(0, max(1, n - 4), 6)]
        assert parts == expected and set(" ".join(parts).split()) == set(text.split())


def test_chunks_and_unindexed(spark):
    pages = spark.createDataFrame([
        (0, "8817", "8817. Ladders", "u", "Home 8817. Ladders " + "a ladder stands on firm ground and is tied at its top " * 36),
        (1, "23", "23. Lamps", "u", "23. Lamps Every lamp is switched off before the last person leaves the hall."),
        (2, "91", "91. Keys", "u", "91. Keys Keep them."), (3, "7000", "7000. TOOLS", "u", "7000. TOOLS hammers saws planes chisels files rasps drills clamps"),
    ], "page_order int, rule_no string, title string, url string, text string")
    rows = CH.numbered_chunks(pages).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == [0, 1, 2] and [r.rule_no for r in rows] == ["8817", "8817", "23"]
    assert sorted(r.rule_no for r in CH.unindexed_pages(pages).collect()) == ["7000", "91"]
