"""Rulebook pages: the rule's own text and its word windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.functions import patterns as P
from casemill.functions.arrays import collapse_space, empty_array, let, strip, words


def rule_body(text: Column, title: Column) -> Column:
    """From the title's last appearance to the footer or amendment history."""
    def after_title(t: Column) -> Column:
        named = (F.coalesce(title, F.lit("")) != "") & F.contains(t, title)
        # the last appearance may overlap itself, so look from the end of the reversed text
        at = _last_index(t, title)
        return F.struct(F.when(named, F.substring(t, at + F.length(title), F.length(t))).otherwise(t).alias("body"),
                        F.when(named, 0).otherwise(P.FOOTER_FROM_WITHOUT_TITLE).alias("first"))

    def cut_footer(body: Column, footer: str, first: Column) -> Column:
        def cut(b: Column) -> Column:
            at = F.instr(b, F.lit(footer))  # 1-based, 0 when absent
            return F.when(at > first, F.substring(b, F.lit(1), at - 1)).otherwise(b)
        return let(body, cut)

    def cut_footers(s: Column) -> Column:
        body = F.regexp_replace(strip(s["body"]), P.PAGE_TABS, "")
        for footer in P.PAGE_FOOTERS:
            body = cut_footer(body, footer, s["first"])
        return body

    def cut_history(b: Column) -> Column:
        first = F.get(F.split(b, rf"(?U)\s(?:{P.RULE_HISTORY})", 2), F.lit(0))
        return strip(let(first, lambda x: F.when(F.length(x) > 0, x).otherwise(b)))

    return let(let(let(collapse_space(F.coalesce(text, F.lit(""))), after_title), cut_footers), cut_history)


def _last_index(text: Column, part: Column) -> Column:
    """1-based start of the last appearance of ``part`` in ``text``; 0 when absent."""
    found = F.instr(F.reverse(text), F.reverse(part))
    return F.when(found > 0, F.length(text) - F.length(part) - found + 2).otherwise(0)


def word_windows(text: Column, size: int = C.CHUNK_WORDS, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """The text itself when it has at most ``size`` words, else windows of ``size`` words sharing ``overlap``."""
    return let(words(text), lambda w: _windows(text, w, size, overlap))


def indexed_windows(text: Column) -> Column:
    """``word_windows`` of a body, none if it is too short to hold a rule."""
    return let(words(text), lambda w: F.when(F.size(w) >= C.CHUNK_MIN_WORDS, _windows(text, w, C.CHUNK_WORDS, C.CHUNK_OVERLAP))
               .otherwise(empty_array("string")))


def _windows(text: Column, w: Column, size: int, overlap: int) -> Column:
    last = F.greatest(F.size(w) - overlap, F.lit(1)) - 1
    return F.when(F.size(w) <= size, F.array(text)).otherwise(F.transform(
        F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))


def may_be_indexed(rule_no: Column) -> Column:
    """Whether a page is no series page."""
    return ~rule_no.rlike(P.SERIES_PAGE)


def indexable(rule_no: Column, body: Column) -> Column:
    """Whether a page is indexed: not a series page, and not too short to hold a rule."""
    return may_be_indexed(rule_no) & (F.size(words(body)) >= C.CHUNK_MIN_WORDS)


def search_tokens(text: Column) -> Column:
    """Lower-case search words without stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(P.SEARCH_TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(*C.STOP_WORDS))


def classifier_words(text: Column) -> Column:
    """Lower-case words of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(P.CLASSIFIER_TOKEN), F.lit(0))


def classifier_terms(text: Column) -> Column:
    """Lower-case words of two or more characters and the pairs of neighbouring ones."""
    def with_pairs(w: Column) -> Column:
        pairs = F.when(F.size(w) > 1, F.transform(
            F.slice(w, 2, F.size(w)), lambda second, i: F.concat_ws(" ", F.get(w, i), second)))
        return F.concat(w, F.coalesce(pairs, empty_array("string")))
    return let(classifier_words(text), with_pairs)
