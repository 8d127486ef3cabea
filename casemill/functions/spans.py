"""Regular-expression matches with their offsets, and replacement by a computed string.

Spark has no function that returns match offsets. One ``regexp_replace`` wraps every match in marker
characters, a split at the marker gives gaps and matches alternately, and the lengths give the offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions.arrays import cut, empty_array, let, scan

EDGE, INNER, _BLANK = "\x01", "\x02", "\x04"
SPAN = "struct<start:int,end:int,head:string,body:string,tail:string>"


def without_markers(text: Column) -> Column:
    """The text with marker characters blanked out; same length, so offsets hold."""
    return F.translate(text, EDGE + INNER, _BLANK * 2)


def marked(text: Column, pattern: str | Column, groups: bool = True) -> Column:
    """The text with every match wrapped in markers, or null without a match.

    The pattern has three groups (head, body, tail) that together make up the match; with ``groups=False`` it
    needs none and the whole match is the body. The text must be free of markers (``without_markers``).
    """
    replacement = EDGE + (f"$1{INNER}$2{INNER}$3" if groups else f"{INNER}$0{INNER}") + EDGE
    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return let(F.regexp_replace(text, regex, F.lit(replacement)), lambda done: F.when(done != text, done))


def offsets(parts: Column) -> Column:
    """Where each part begins in the joined text."""
    def begins(lengths: Column) -> Column:
        ends = scan(lengths, lambda a, b: a + b, F.lit(0), "int")
        return F.zip_with(ends, lengths, lambda end, length: end - length)
    # one match: its gap begins the text
    few = F.array(F.lit(0), F.length(F.get(parts, F.lit(0))), F.length(F.get(parts, F.lit(0))) + F.length(F.get(parts, F.lit(1))))
    return F.when(F.size(parts) == 3, few).otherwise(let(F.transform(parts, F.length), begins))


def spans_in(marked_text: Column) -> Column:
    """``array<struct<start,end,head,body,tail>>`` of a marked text: 0-based, end-exclusive offsets."""
    def build(parts: Column) -> Column:
        return let(offsets(parts), lambda starts: spans(parts, starts))

    def spans(parts: Column, starts: Column) -> Column:
        def span(i: Column) -> Column:
            # every second part is a match and carries two inner markers
            before = F.get(starts, i) - (i - 1)
            return let(
                F.struct(before.alias("start"), F.split(F.get(parts, i), INNER).alias("groups")),
                lambda m: F.struct(
                    m["start"].alias("start"),
                    (m["start"] + F.length(F.get(parts, i)) - 2).alias("end"),
                    F.get(m["groups"], F.lit(0)).alias("head"),
                    F.get(m["groups"], F.lit(1)).alias("body"),
                    F.get(m["groups"], F.lit(2)).alias("tail")))
        return F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), span)
    return F.when(marked_text.isNull(), empty_array(SPAN)).otherwise(let(F.split(marked_text, EDGE), build))


def find_spans(text: Column, pattern: str | Column, groups: bool = True) -> Column:
    """Matches of one pattern with their offsets."""
    return let(marked(text, pattern, groups), spans_in)


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each of the ordered, disjoint spans replaced by ``replacement(span)``."""
    def rebuilt(s: Column) -> Column:
        def joined(between: Callable[[Column, Column], Column]) -> Column:
            pieces = F.transform(s, lambda x, i: F.concat(
                between(F.coalesce(F.get(s, i - 1)["end"], F.lit(0)), x["start"]), replacement(x)))
            rest = F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(0))
            return F.concat(F.array_join(pieces, ""), between(rest, F.length(text)))
        return F.when(F.size(s) == 0, text).otherwise(cut(text, joined))
    return let(spans, rebuilt)


def replace_each(text: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """The text with every match of one pattern replaced by ``replacement(match)``; needs no offsets."""
    def joined(done: Column) -> Column:
        parts = F.transform(F.split(done, EDGE), lambda p, i: F.when(i % 2 == 1, replacement(F.replace(p, F.lit(INNER), F.lit("")))).otherwise(p))
        return F.array_join(parts, "")
    return F.coalesce(joined(marked(text, pattern, groups=False)), text)
