"""Small column helpers shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions.patterns import WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_array(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE, " ")


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both sides (``trim`` only removes spaces)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def joined(parts: Column, by: str = "|") -> Column:
    return F.array_join(parts, by)


def split_keys(keys: Column) -> Column:
    """``'A|B '`` as an array of trimmed, non-empty keys; null reads as no keys."""
    parts = F.transform(F.split(F.coalesce(keys, F.lit("")), r"\|"), lambda k: F.trim(k))
    return F.filter(parts, lambda k: k != "")


def key_set(keys: Column) -> Column:
    return F.array_distinct(split_keys(keys))


def words(text: Column) -> Column:
    """Whitespace-separated words, none for a blank text."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def run_lengths(values: Column, value: str, count: str) -> Column:
    """Distinct values of an array with their counts, as an array of structs.

    Sorting the row's own array replaces an explode, a shuffle and a group-by per (row, value).
    """
    def counted(ordered: Column) -> Column:
        size = F.size(ordered)
        index = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(empty_array("int"))
        starts = F.filter(index, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda begin, j: F.struct(
            F.get(ordered, begin).alias(value),
            (F.coalesce(F.get(s, j + 1), size) - begin).alias(count))))
    return let(F.sort_array(values), counted)


def scan(values: Column, combine: Callable[[Column, Column], Column], zero: Column, ddl: str, block: int = 128) -> Column:
    """Running results of an associative ``combine`` over an array: element i covers elements 0 to i.

    Two levels: blocks are folded on their own, then their totals, and each block is shifted by the total before it.
    A single fold that appends would copy its result at every element. ``values`` is read once a block:
    ``let`` it where it is computed.
    """
    def fold(part: Column) -> Column:
        return F.aggregate(
            part, F.struct(zero.cast(ddl).alias("last"), empty_array(ddl).alias("all")),
            lambda acc, x: F.struct(combine(acc["last"], x).alias("last"), F.concat(acc["all"], F.array(combine(acc["last"], x))).alias("all")),
            lambda acc: acc["all"])

    def shifted(parts: Column) -> Column:
        totals = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(totals, lambda t: F.flatten(F.transform(parts, lambda p, b: F.transform(
            p, lambda x: F.when(b == 0, x).otherwise(combine(F.get(t, b - 1), x))))))

    begins = F.sequence(F.lit(0), F.size(values) - 1, F.lit(block))
    blocks = let(F.transform(begins, lambda i: fold(F.slice(values, i + 1, block))), shifted)
    return F.when(F.size(values) > block, blocks).when(F.size(values) > 0, fold(values)).otherwise(empty_array(ddl))


def cut(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column], block: int = 1024) -> Column:
    """``body`` gets a function (begin, end) -> the text between two offsets.

    ``substring`` counts characters from the text's start at every call; here the text is cut into short blocks once
    and only these are counted.
    """
    def pieces(parts: Column) -> Column:
        def between(begin: Column, end: Column) -> Column:
            first, last = F.floor(begin / block).cast("int"), F.floor((end - 1) / block).cast("int")
            head = F.substring(F.get(parts, first), begin % block + 1, F.least(end - begin, F.lit(block)))
            tail = F.substring(F.get(parts, last), F.lit(1), (end - 1) % block + 1)
            middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            return F.when(end <= begin, F.lit("")).when(first == last, head).otherwise(F.concat(head, middle, tail))
        return body(between)

    def chosen(t: Column) -> Column:
        short = body(lambda begin, end: F.substring(t, begin + 1, F.greatest(end - begin, F.lit(0))))
        return F.when(F.length(t) <= block, short).otherwise(let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), pieces))
    return let(text, chosen)
