"""Main text of web pages by inferred wrappers.

A wrapper is a union-free regular expression over the block tags of a host's pages: tags in order, ``#`` for a text slot,
``(...)+`` for a repeated group and ``(...)?`` for an optional one. A page's own token stream is a wrapper to start with;
the wrappers of a host are aligned two at a time. Where tags agree, their contents are aligned in turn; a mismatch becomes
an optional group, or a repeated one if the group stands next to itself; text against other text becomes a slot.

Pages of one host mostly share a shape, so shapes are counted first (combined in each task), then aligned in salted parts,
then the parts' wrappers per host: a host with a third of all pages costs no more than its different shapes. The wrapper
says which containers hold the article; extraction reads each page once more, whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from casemill.llm.urlrules import host_and_path
from casemill.sources.session import written

#: Parts in which a host's shapes are aligned before the parts' wrappers are.
SALTS = 16

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q ruby rb rt rp s samp small span "
                   "strike strong sub sup time tt u var wbr nobr picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text: the content goes with the tag.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "select")
#: Containers beside the article, by tag.
ASIDE = frozenset("nav footer aside form head button dialog menu fieldset title".split())
#: Containers beside the article, by a word of their class, id or role.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup "
    "modal newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer "
    "header masthead topbar toolbar comment comments disqus respond replies related recommended share sharing social widget widgets "
    "pagination pager search skip complementary contentinfo hidden".split())
#: Words of an ``article`` or ``main`` that is none.
NOT_ARTICLE = frozenset("comment comments respond replies related recommended hidden".split())
#: Words that make a name one of the page's layout, such as ``content-with-sidebar``.
LAYOUT = frozenset("with without has no layout page site".split())
#: Containers that hold the article, by tag or by a word of their class, id or role.
MAIN = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content post entry story".split())
#: A new one closes an open one of the same set.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
#: Blocks whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
WORD = re.compile(r"[a-z]+")
#: Blocks that are text, whatever their names say; of containers in an article, only these are judged by their names.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
NAMED = frozenset("div section ul ol table article main".split())


def label_of(tag: str, attributes: str) -> str:
    """The tag with the names of its class, id and role, the words of a name joined by ``-``; digits are left out, so
    numbered names are one name. An id starts with ``=``. What is not shown gets the name ``!``."""
    names = []
    for m in ATTRIBUTE.finditer(attributes or ""):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id", "role"):
            names += ["=" * (key == "id") + "-".join(words) for name in value.lower().split() if (words := WORD.findall(name))]
        elif key == "hidden" or key == "style" and NO_DISPLAY.search(value) or key == "aria-hidden" and value.strip().lower() == "true":
            names.append("!")
    return ".".join([tag, *dict.fromkeys(names)])


def words_of(names: list[str]) -> set[str]:
    """The words of names; ``hidden`` counts only as a whole name."""
    found = {w for n in names for w in n.lstrip("=").split("-")}
    return found if "hidden" in names or "=hidden" in names else found - {"hidden"}


def is_aside(label: str, in_article: bool = False) -> bool:
    """A container beside the article. A header counts as one only outside the article: inside it has the title. Inside,
    an aside word must be a whole name, and the id of a section is an anchor unless it names comments or the like."""
    tag, *names = label.split(".")
    if "!" in names or tag in ASIDE or tag == "header" and not in_article:
        return True
    if tag in MAIN:
        return bool(NOT_ARTICLE.intersection(words_of(names)))
    if tag in ("html", "body") or tag in PROSE or in_article and tag not in NAMED:
        return False
    if LAYOUT.intersection(words_of(names)):
        return False
    if in_article:
        return any(n.lstrip("=") in (NOT_ARTICLE if tag == "section" and n[0] == "=" else ASIDE_WORDS) for n in names)
    return bool(ASIDE_WORDS.intersection(words_of(names)))


def is_main(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in MAIN or tag in ("div", "section", "td") and bool(MAIN_WORDS.intersection(words_of(names))) and not is_aside(label)


def blocks(page: str | None) -> Iterator[tuple[tuple[str, ...], str]]:
    """The block containers of each place of a page, outermost first, with its text; empty text marks a new container.

    Broken markup is repaired the way browsers do for blocks: list items, cells and paragraphs end at the next one, an
    end tag closes what is open inside it, and one without a start is ignored.
    """
    stack: list[str] = []
    tags: list[str] = []
    text: list[str] = []

    def flush() -> Iterator[tuple[tuple[str, ...], str]]:
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            yield tuple(stack), joined

    def close(to: int) -> None:
        del stack[to:], tags[to:]

    for m in TOKEN.finditer(page or ""):
        if (part := m["text"]) is not None:
            text.append(part)
            continue
        if m["cdata"]:
            text.append(html.escape(m["cdata"]))
            continue
        tag = (m["tag"] or "").lower()
        if not tag or tag in INLINE:
            continue
        yield from flush()
        if m["end"]:
            if tag in tags:
                close(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tag in ENDS_P and tags and tags[-1] == "p":
            close(len(tags) - 1)
        if tag in CLOSES:
            barrier = max((i for i, t in enumerate(tags) if t in ("ul", "ol", "dl", "table", "select")), default=-1)
            open_ones = [i for i, t in enumerate(tags) if t in CLOSES[tag] and i > barrier]
            if open_ones:
                close(open_ones[0])
        if tag not in VOID and not (m["attrs"] or "").endswith("/"):
            stack.append(label_of(tag, m["attrs"]))
            tags.append(tag)
            yield tuple(stack), ""
    yield from flush()


#: A wrapper node: label, flag ("", "?", "+", "*") and children; a text slot is ("#", flag, ()).
Node = tuple


def shape(page: str | None) -> Node:
    """The page's block tags as a wrapper of its own, with what stands next to itself already repeated groups."""
    root: list = ["", "", []]
    path: list[tuple[tuple[str, ...], list]] = [((), root)]
    for place, text in blocks(page):
        while len(path) > 1 and (len(path[-1][0]) > len(place) or place[:len(path[-1][0])] != path[-1][0] or (not text and len(path[-1][0]) == len(place))):
            path.pop()
        if text:
            path[-1][1][2].append(["#", "", []])
        else:
            node = [place[-1], "", []]
            path[-1][1][2].append(node)
            path.append((place, node))

    def folded(node: list) -> Node:
        return node[0], node[1], folded_groups([folded(c) for c in node[2]])

    return folded(root)


def folded_groups(children: list[Node]) -> tuple[Node, ...]:
    """Neighbours with one label become one repeated node that matches them all."""
    out: list[Node] = []
    for c in children:
        if out and out[-1][0] == c[0]:
            both = align(out[-1], c)
            out[-1] = (both[0], "*" if both[1] in "?*" and both[1] else "+", both[2])
        else:
            out.append(c)
    return tuple(out)


def flag(a: str, b: str) -> str:
    repeated, optional = (a + b).count("+") + (a + b).count("*"), (a + b).count("?") + (a + b).count("*")
    return "*" if repeated and optional else "+" if repeated else "?" if optional else ""


def optional(node: Node) -> Node:
    return node[0], flag(node[1], "?"), node[2]


def align(a: Node, b: Node) -> Node:
    """One wrapper for all that either of two wrappers with the same label matches.

    Children meet in order along a longest common sequence of labels; the others become optional, and neighbours of one
    label a repeated group.
    """
    if a == b:
        return a
    x, y = a[2], b[2]
    longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][0] == y[j][0]:
            out.append(align(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and longest[i + 1][j] >= longest[i][j + 1]:
            out.append(optional(x[i]))
            i += 1
        else:
            out.append(optional(y[j]))
            j += 1
    return a[0], flag(a[1], b[1]), folded_groups(out)


def render(node: Node) -> str:
    """The wrapper as text; labels hold no special characters, so ``parse`` gives it back."""
    return f"{node[0]}{node[1]}" + (f"({','.join(map(render, node[2]))})" if node[2] else "")


def parse(text: str) -> Node:
    def node(at: int) -> tuple[Node, int]:
        end = at
        while end < len(text) and text[end] not in "?+*(),":
            end += 1
        label, mark, children = text[at:end], "", []
        if end < len(text) and text[end] in "?+*":
            mark, end = text[end], end + 1
        if end < len(text) and text[end] == "(":
            while text[end] in "(,":
                child, end = node(end + 1)
                children.append(child)
            end += 1
        return (label, mark, tuple(children)), end

    return node(0)[0]


def merged(texts: Iterable[str]) -> str:
    """One wrapper for all; in sorted order, so the result does not depend on how rows arrive."""
    found: Node | None = None
    for t in sorted(texts):
        found = parse(t) if found is None else align(found, parse(t))
    return render(found) if found is not None else ""


def article_paths(wrapper: str) -> list[str]:
    """Container paths that hold the article: all marked containers; last, for pages without them, the container that
    holds every text slot not beside the article."""
    marked, plain = [], []

    def walk(node: Node, path: tuple[str, ...]) -> None:
        here = (*path, node[0]) if node[0] else path
        if node[0] and is_aside(node[0]):
            return
        if node[0] and is_main(node[0]):
            marked.append(here)
        if any(c[0] == "#" for c in node[2]):
            plain.append(here)
        for c in node[2]:
            if c[0] != "#":
                walk(c, here)

    walk(parse(wrapper), ())
    common = plain[0] if plain else ()
    for p in plain:
        common = common[:next((i for i, (x, y) in enumerate(zip(common, p)) if x != y), min(len(common), len(p)))]
    paths = sorted(set(marked)) + [common] * bool(common)
    return list(dict.fromkeys("/".join(p) for p in paths))


def main_text(page: str | None, paths: list[str]) -> str:
    """Text of all outermost article containers that the page has, in page order, without containers beside the article.

    In a container that holds article tags, only what is inside one of them is judged as in an article. Pages without a
    marked container give the text of the unmarked one, and if they have none of it, that of the body.
    """
    places = [(place, text) for place, text in blocks(page) if text]
    wanted = {tuple(p.split("/")) for p in paths}
    marked = {p for p in wanted if is_main(p[-1])}
    holders = {p[:n] for p in marked if p[-1].split(".")[0] == "article" for n in range(1, len(p))}

    def in_marked(place: tuple[str, ...]) -> bool:
        start = next((n for n in range(1, len(place) + 1) if place[:n] in marked), 0)
        if not start:
            return False
        own = next((n for n in range(start, len(place) + 1) if place[n - 1].split(".")[0] == "article"), len(place) + 1)
        site = place[:start] in holders
        return not any(is_aside(x, in_article=not site or n >= own) for n, x in enumerate(place[start:], start))

    def in_plain(place: tuple[str, ...]) -> bool:
        start = next((n for n in range(1, len(place) + 1) if place[:n] in wanted), 0)
        return start > 0 and not any(is_aside(x, in_article=x.split(".")[0] == "header" and place[n - 1].split(".")[0] not in ("html", "body"))
                                     for n, x in enumerate(place[start:], start))

    for inside in (in_marked, in_plain):
        if found := [text for place, text in places if inside(place)]:
            return " ".join(found)
    return " ".join(text for place, text in places if not any(map(is_aside, place)))


def host_of(url: Column) -> Column:
    return host_and_path(F.coalesce(url, F.lit("")))[0]


def infer(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: one wrapper per host from every page of ``pages(url, html)``; null urls are the empty host."""
    @F.pandas_udf(StringType())
    def shape_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pd.Series([render(shape(p)) for p in pages_], dtype=object)

    def align_all(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([merged(table.column("wrapper").to_pylist())], pa.string())})

    shapes = pages.select(host_of(F.col("url")).alias("host"), shape_of("html").alias("wrapper")).distinct()
    salted = shapes.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    parts = salted.groupBy("host", "salt").applyInArrow(align_all, "host string, wrapper string").distinct()
    return parts.groupBy("host").applyInArrow(align_all, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``, repeated rows included.

    Null and empty pages have an empty text. Rows of one host share its wrapper; pages without a host share one.
    """
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = []
                for wrapper, page in zip(part.column("wrapper").to_pylist(), part.column("html").to_pylist()):
                    if wrapper not in known:
                        known[wrapper] = article_paths(wrapper or "")
                    found.append(main_text(page, known[wrapper]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = written(infer(pages))
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(
        texts, "page_id bigint, url string, text string, n_chars bigint")
