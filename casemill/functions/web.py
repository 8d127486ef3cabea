"""HTML and URLs: page text, links, listing rows, canonical addresses."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions import patterns as P
from casemill.functions.arrays import let, strip
from casemill.functions.rules import literal_map
from casemill.functions.spans import find_spans, splice, without_markers

_ENTITY = r"(&)(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31})(;)"
_ANCHOR = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)</a\s*>"""
_HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_DROPPED = ("script", "style", "nav", "header", "footer")


def decode_entities(text: Column) -> Column:
    """Character references as characters; unknown names stay as they are."""
    names = literal_map({k: chr(v) for k, v in name2codepoint.items()} | {"apos": "'"})

    def character(m: Column) -> Column:
        code = m["body"]
        digits = F.when(code.rlike("^#[xX]"), F.conv(F.substring(code, 3, 8), 16, 10)).otherwise(F.substring(code, 2, 8))
        point = digits.try_cast("int")
        valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point.cast("bigint")), 8, "0")), "UTF-32"))
        whole = F.concat(m["head"], code, m["tail"])
        return F.coalesce(F.when(code.startswith("#"), numeric).otherwise(F.try_element_at(names, code)), whole)
    decoded = let(without_markers(text), lambda t: splice(t, find_spans(t, _ENTITY), character))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def text_nodes(html: Column) -> Column:
    """Non-empty stripped text between tags, in page order."""
    nodes = F.transform(F.split(html, r"(?s)<[^>]*>"), lambda s: strip(decode_entities(s)))
    return F.filter(nodes, lambda s: s != "")


def main_text(html: Column) -> Column:
    """Text of the page's main part (else its body), one line per text node."""
    page = F.regexp_replace(html, r"(?s)<!--.*?-->|(?i)<!doctype[^>]*>", "")
    for tag in _DROPPED:
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")

    def inside(p: Column) -> Column:
        main = F.regexp_extract(p, r"(?is)<main\b[^>]*>(.*?)</main\s*>", 1)
        body = F.regexp_extract(p, r"(?is)<body\b[^>]*>(.*)", 1)
        return F.coalesce(F.nullif(main, F.lit("")), F.nullif(body, F.lit("")), p)
    return F.array_join(text_nodes(let(page, inside)), "\n")


def page_title(html: Column) -> Column:
    """The first h1's text, else the title's."""
    def text_of(tag: str) -> Column:
        inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
        return F.array_join(text_nodes(inner), " ")
    return F.when(html.rlike(r"(?is)<h1\b[^>]*>.*?</h1\s*>"), text_of("h1")).otherwise(text_of("title"))


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    last = F.get(segments, F.size(segments) - 1)
    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))))
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def absolute_url(page_url: Column, href: Column) -> Column:
    """``href`` resolved against the page it stands on."""
    link = strip(href)
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_extract(page_url, r"^([^?#]*)", 1)
    path = F.substring(plain, F.length(origin) + 1, F.length(plain))
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    link_path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link == "", page_url)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("#"), F.concat(F.substring_index(page_url, "#", 1), link))
            .when(link.startswith("?"), F.concat(plain, link))
            .when(link.startswith("/"), F.concat(origin, _without_dots(link_path), rest))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, link_path)), rest)))


def hrefs(html: Column) -> Column:
    """Every anchor's href as written, in page order."""
    quoted = [F.regexp_extract_all(html, F.lit(_HREF), F.lit(g)) for g in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[q.alias(f"g{i}") for i, q in enumerate(quoted)]),
                       lambda z: decode_entities(F.concat(z["g0"], z["g1"], z["g2"])))


def links(html: Column, page_url: Column) -> Column:
    """Absolute link targets in page order."""
    return F.transform(hrefs(html), lambda h: absolute_url(page_url, h))


def anchors(html: Column, page_url: Column) -> Column:
    """``array<struct<url, text>>`` of the page's anchors."""
    groups = [F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(g)) for g in (1, 2, 3, 4)]
    return F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda z: F.struct(
        absolute_url(page_url, decode_entities(F.concat(z["g0"], z["g1"], z["g2"]))).alias("url"),
        F.array_join(text_nodes(z["g3"]), " ").alias("text")))


def report_links(html: Column, page_url: Column) -> Column:
    """Links that look like monthly reports, fragment cut, first-seen order, no repeats."""
    kept = F.filter(links(html, page_url), lambda u: F.substring_index(u, "?", 1).rlike(P.REPORT_LINK)
                    & ~u.rlike(P.REPORT_LINK_SKIP))
    return F.array_distinct(F.transform(kept, lambda u: F.substring_index(u, "#", 1)))


def pdf_on_page(html: Column, page_url: Column) -> Column:
    """The first PDF whose address or anchor text names a disciplinary report, or null."""
    named = F.filter(anchors(html, page_url), lambda a: F.lower(a["url"]).endswith(".pdf")
                     & F.concat(a["url"], a["text"]).rlike(P.PDF_ANCHOR) & ~a["url"].rlike(P.REPORT_LINK_SKIP))
    return F.get(named, F.lit(0))["url"]


def document_links(html: Column, page_url: Column, key: Column) -> Column:
    """PDF links that carry the key in their address or anchor text, first-seen order, no repeats."""
    kept = F.filter(anchors(html, page_url), lambda a: F.lower(a["url"]).endswith(".pdf")
                    & (F.contains(a["url"], key) | F.contains(a["text"], key)))
    return F.array_distinct(F.transform(kept, lambda a: a["url"]))


def canonical_url(url: Column) -> Column:
    """One https address per page: no query, fragment, ``/index.php`` or closing slash; lower-case host."""
    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    path = F.rtrim(F.regexp_replace(path, r"^/index\.php(?=/)", ""), F.lit("/"))
    return F.concat(F.lit("https://"), host, F.coalesce(F.nullif(path, F.lit("")), F.lit("/")))


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def rule_links(html: Column, page_url: Column) -> Column:
    """Canonical addresses of rule pages linked from a page, first-seen order, no repeats."""
    pages = F.array_distinct(F.transform(links(html, page_url), canonical_url))
    return F.filter(pages, lambda u: url_path(u).rlike(P.RULE_LINK))


def rule_no_of(url: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(url_path(url), P.RULE_LINK, 1), F.lit("")))


def table_rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)(<tr\b[^>]*>.*?</tr\s*>)"), F.lit(1))


def _cell(row: Column, css_class: str) -> Column:
    pattern = rf'(?is)<td\b[^>]*\bclass\s*=\s*"(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"[^>]*>(.*?)</td\s*>'
    return F.when(row.rlike(pattern), F.regexp_extract(row, pattern, 1))


def listing_row(row: Column, page_url: Column) -> Column:
    """``struct<case_no, doc_url, doc_type, respondent, action_date>`` of a listing row; null without a document."""
    def read(cell: Column) -> Column:
        return let(F.get(links(cell, page_url), F.lit(0)), lambda url: F.when(url.isNotNull(), of(cell, url)))

    def of(cell: Column, url: Column) -> Column:
        def text_of(css: str) -> Column:
            return F.array_join(text_nodes(_cell(row, P.LISTING_CELLS[css])), " ")
        name = F.coalesce(F.try_url_decode(F.regexp_replace(F.substring_index(url, "/", -1), r"\+", "%2B")), url)
        in_name = F.nullif(F.regexp_extract(name, P.CASE_IN_FILE_NAME, 1), F.lit(""))
        in_text = F.nullif(F.regexp_replace(F.array_join(text_nodes(cell), ""), r"(?U)\D", ""), F.lit(""))
        return F.struct(
            F.coalesce(in_name, in_text).alias("case_no"), url.alias("doc_url"),
            text_of("doc_type").alias("doc_type"), text_of("respondent").alias("respondent"),
            F.try_to_date(text_of("action_date"), "MM/dd/yyyy").alias("action_date"))
    return let(_cell(row, P.LISTING_CELLS["file"]), read)
