"""Queries over web pages: links, addresses, page text, listings, rule pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import web
from casemill.operators import chunks as CH
from casemill.queries import derived as D

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def _pages(spark, d):
    return D.spread_table(spark, d, "pages", "page_id")


_LINKS = """WITH h AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
    regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*"([^"]*)"', 1) AS hs FROM pages),
  e AS (SELECT page_id, url, origin, unnest(hs) AS href, generate_subscripts(hs, 1) AS i FROM h),
  f AS (SELECT page_id, i, origin, replace(href, '&amp;', '&') AS href, url FROM e),
  a AS (SELECT page_id, i, split_part(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href = '' OR href LIKE '#%' THEN url
    WHEN href LIKE '/%' THEN origin || href ELSE '?' || href END, '#', 1) AS link FROM f),
  firsts AS (SELECT page_id, link, min(i) AS i FROM a GROUP BY page_id, link)"""


@query(_LINKS + " SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, link FROM firsts")
def page_links(spark, d):
    return CH.link_rows(_pages(spark, d))


@query("""WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, 'http://', 'HTTP://') || '#top'
      WHEN 1 THEN regexp_replace(url, '^(https?://[^/]*)', '\\1/index.php') || '/' ELSE url END AS url FROM pages)
  SELECT page_id, 'https://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || coalesce(nullif(rtrim(regexp_replace(
    regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '^[A-Za-z]+://[^/]*', ''), '^/index\\.php/', '/'), '/'), ''), '/') AS address FROM u""")
def canonical_urls(spark, d):
    url, k = F.col("url"), F.col("page_id") % 3
    spelled = (F.when(k == 0, F.concat(F.replace(url, F.lit("http://"), F.lit("HTTP://")), F.lit("#top")))
               .when(k == 1, F.concat(F.regexp_replace(url, "^(https?://[^/]*)", "$1/index.php"), F.lit("/"))).otherwise(url))
    return D.table(spark, d, "pages", "page_id", "url").select("page_id", web.canonical_url(spelled).alias("address"))


_WS = "\\s\\x0B\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_ENT = ("replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')")


def _removed(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->|(?i)<!doctype[^>]*>', '', 'g')"
    for tag in ("script", "style", "nav", "header", "footer"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return out


@query(f"""WITH p AS (SELECT page_id, {_removed('html')} AS h, html FROM pages),
  m AS (SELECT page_id, html, coalesce(nullif(regexp_extract(h, '(?is)<main\\b[^>]*>(.*?)</main\\s*>', 1), ''), nullif(regexp_extract(h, '(?is)<body\\b[^>]*>(.*)', 1), ''), h) AS h FROM p),
  t AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(h, '(?s)<[^>]*>', chr(1), 'g'), chr(1)),
      lambda x: regexp_replace({_ENT.format('x')}, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') AS nodes,
      list_filter(list_transform(string_split(regexp_replace(CASE WHEN regexp_matches(html, '(?is)<h1\\b[^>]*>.*?</h1\\s*>') THEN regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)
        ELSE regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) END, '(?s)<[^>]*>', chr(1), 'g'), chr(1)),
      lambda x: regexp_replace({_ENT.format('x')}, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') AS title FROM m)
  SELECT page_id, array_to_string(title, ' ') AS title, array_to_string(nodes, chr(10)) AS text FROM t""")
def page_texts(spark, d):
    return CH.page_texts(_pages(spark, d)).drop("url")


def _linked(spark, d):
    """Pages that link report files, rule pages and documents under several spellings."""
    k = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<p><a class=x href='/sites/files/2024-01/disciplinary-actions-may-2024.pdf?v="), k, F.lit("#p1'>May</a>"),
        F.lit('<a href="../quarterly-disciplinary-actions-'), k, F.lit('.pdf">Q</a>'),
        F.lit('<a href="a/../../rules-guidance/disciplinary-actions/june-2024">June</a>'),
        F.lit('<a href="/index.php/rules-guidance/rulebooks/finra-rules/'), (F.col("page_id") % 90000 + 1000).cast("string"), F.lit('/">r</a>'),
        F.lit('<a href="//WWW.example.org/rules-guidance/rulebooks/finra-rules/'), (F.col("page_id") % 90000 + 1000).cast("string"), F.lit('?x=1#y">r</a>'),
        F.lit('<a href="docs/'), k, F.lit('_AWC.pdf">AWC</a><a href="other.PDF">case <b>'), k, F.lit('</b></a><a href=bare.pdf>none</a></p>'))
    return D.table(spark, d, "pages", "page_id").select("page_id", F.lit("https://www.example.org/a/b/list?page=1").alias("url"), html.alias("html"))


@query("""SELECT page_id, 0 AS pos, 'https://www.example.org/sites/files/2024-01/disciplinary-actions-may-2024.pdf?v=' || CAST(page_id AS VARCHAR) AS link FROM pages
  UNION ALL SELECT page_id, 1, 'https://www.example.org/a/rules-guidance/disciplinary-actions/june-2024' FROM pages""")
def report_links(spark, d):
    return CH.report_link_rows(_linked(spark, d))


@query("""SELECT page_id, 'https://www.example.org/rules-guidance/rulebooks/finra-rules/' || CAST(page_id % 90000 + 1000 AS VARCHAR) AS rules,
  'https://www.example.org/sites/files/2024-01/disciplinary-actions-may-2024.pdf?v=' || CAST(page_id AS VARCHAR) AS first_link FROM pages""")
def rule_links(spark, d):
    found = web.rule_links(F.col("html"), F.col("url"))
    first = F.substring_index(F.get(web.links(F.col("html"), F.col("url")), F.lit(0)), "#", 1)
    return _linked(spark, d).select("page_id", F.array_join(found, "|").alias("rules"), first.alias("first_link"))


@query("""SELECT page_id, concat_ws('|', 'https://www.example.org/a/quarterly-disciplinary-actions-' || CAST(page_id AS VARCHAR) || '.pdf',
  'https://www.example.org/a/b/docs/' || CAST(page_id AS VARCHAR) || '_AWC.pdf', 'https://www.example.org/a/b/other.PDF') AS documents FROM pages""")
def document_links(spark, d):
    key = F.col("page_id").cast("string")
    found = web.document_links(F.col("html"), F.col("url"), key)
    return _linked(spark, d).select("page_id", F.array_join(found, "|").alias("documents"))


def _listing(spark, d):
    """A listing page per customer: one table row per order."""
    k = F.col("o_orderkey")
    named = F.concat(F.lit("20"), F.lpad(k.cast("string"), 10, "0"))
    row = F.concat(
        F.lit('<tr class="r"><td class="views-field views-field-field-fda-attachment-file-media">\n <a href="/files/'),
        F.when(k % 2 == 0, F.concat(named, F.lit("%20Smith%20AWC.pdf"))).otherwise(F.concat(F.lit("Acme%20"), k.cast("string"), F.lit(".pdf"))),
        F.lit('">'), F.when(k % 2 == 0, "77").otherwise(named), F.lit('</a></td><td class="views-field views-field-views-conditional-field">s</td>'
              '<td class="views-field views-field-field-fda-document-type-tax">'), F.col("o_orderpriority"),
        F.lit(' &amp; co</td>\n<td class="views-field views-field-views-conditional-field-3">Firm <i>'), F.col("o_custkey").cast("string"),
        F.lit('</i></td><td class="views-field views-field-field-core-official-dt is-active">'),
        F.when(k % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")), F.lit("</td></tr>"))
    rows = D.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("rs"))
    return rows.select("page_id", F.lit("https://www.example.org/list?page=1").alias("url"), F.concat(
        F.lit("<table><tr><th>Case</th></tr>"), F.array_join(F.transform("rs", lambda x: x["r"]), "\n"), F.lit("</table>")).alias("html"))


@query("""SELECT '20' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS case_no, 'https://www.example.org/files/' || CASE WHEN o_orderkey % 2 = 0
    THEN '20' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '%20Smith%20AWC.pdf' ELSE 'Acme%20' || CAST(o_orderkey AS VARCHAR) || '.pdf' END AS doc_url,
  o_orderpriority || ' & co' AS doc_type, 'Firm ' || CAST(o_custkey AS VARCHAR) AS respondent, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS action_date FROM orders""")
def listing_rows(spark, d):
    return CH.listing_rows(_listing(spark, d))


@query("""SELECT min(page_id) AS page_id, CAST(1000 + page_id % 90000 AS VARCHAR) AS rule_no, CAST(1000 + page_id % 90000 AS VARCHAR) || '. Title' AS title,
  CAST(1000 + page_id % 90000 AS VARCHAR) || '.' || chr(10) || 'Title' || chr(10) || 'Text é & more' AS text FROM pages GROUP BY page_id % 90000""")
def rule_pages(spark, d):
    no = (F.col("page_id") % 90000 + 1000).cast("string")
    html = F.concat(F.lit("<html><body><nav>menu</nav><main><h1>"), no, F.lit(".<b> Title</b></h1><script>x()</script><p>Text &#233; &#x26; more</p></main><footer>f</footer></body></html>"))
    rows = D.table(spark, d, "pages", "page_id").select(
        "page_id", F.concat(F.lit("https://www.example.org/rules-guidance/rulebooks/finra-rules/"), no).alias("url"), html.alias("html"))
    return CH.rule_pages(rows.unionByName(rows.withColumn("page_id", F.col("page_id") + 1000000000))).drop("url")
