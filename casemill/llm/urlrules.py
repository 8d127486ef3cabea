"""URL rules by a sort-merge range join.

A host turned round, label by label (``www.example.net`` to ``net.example.www.``), makes a host and all its subdomains
one interval of keys. Pages and rules are dealt to ranges of keys: a page to one range, a rule to every range that its
interval meets. Within a range everything is sorted by key, and one sweep keeps a stack of the rules whose intervals
hold the current key, innermost last. Each page asks the stack for the longest rule whose path starts its own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys looked at per range to choose the split points. It bears on balance alone, never on the result.
LOOKED_AT = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    """Labels in reverse, each followed by a dot; an empty host is the empty key, whose interval holds every key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Frame:
    """The active rules of one host: by path, with the path lengths in use, longest first."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.rules: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []

    def add(self, host: str, path: str, action: str) -> None:
        """Of two rules with the same text, one of which blocks, the block holds."""
        if path not in self.rules or action == "block":
            self.rules[path] = (host + path, action)
        self.sizes = sorted({len(p) for p in self.rules}, reverse=True) if len(path) not in self.sizes else self.sizes

    def longest(self, path: str) -> tuple[str, str] | None:
        return next((r for n in self.sizes if n <= len(path) and (r := self.rules.get(path[:n]))), None)


def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows ``(key, is_page, page_id, host, path, action)`` sorted by key, rules before pages; yields judged pages."""
    stack: list[Frame] = []
    for key, is_page, page_id, host, path, action in rows:
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        if not is_page:
            if not stack or stack[-1].key != key:
                stack.append(Frame(key))
            stack[-1].add(host, path, action)
            continue
        found = [r for frame in stack if (r := frame.longest(path))]  # outermost first, so a later one wins a tie
        best = max(reversed(found), key=lambda r: len(r[0]), default=None)
        yield page_id, host, path, best and best[0], best and best[1]


def split_points(keys: DataFrame, ranges: int) -> list[str]:
    """``ranges - 1`` keys at even places of a bounded sample in hash order; the driver holds the sample only."""
    sample = sorted(r.key for r in keys.orderBy(F.xxhash64(*keys.columns)).limit(LOOKED_AT * ranges).collect())
    return [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``, repeated rows included.

    ``rules(host, path, action)``: the longest rule text wins, among equals the one with the longer host; no rule gives
    ``default``. A null url has an empty host and path, which only rules without a host fit. Rules with a null host,
    path or action are ignored; no rules leave every page at the default. Many pages of one host are spread over as
    many ranges as split points fall on its key.
    """
    spark = pages.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    asked = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", reversed_host(F.col("host")))
    points = split_points(asked.select("key", "page_id", "path"), ranges)
    spread = F.pmod(F.xxhash64("page_id", "path"), F.lit(2**31 - 1)).alias("spread")
    asked = asked.select("key", F.lit(True).alias("is_page"), "page_id", "host", "path", F.lit(None).cast("string").alias("action"), spread)
    given = rules.dropna(subset=["host", "path", "action"]).select(
        reversed_host(F.col("host")).alias("key"), F.lit(False).alias("is_page"), F.lit(None).cast("bigint").alias("page_id"),
        "host", "path", "action", F.lit(0).cast("bigint").alias("spread"))
    dealt = asked.unionByName(given).mapInArrow(_dealer(points), "range int, key string, is_page boolean, page_id bigint, host string, path string, action string")
    placed = dealt.repartitionById(ranges, "range").sortWithinPartitions("key", "is_page", "host", "path")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "is_page", "page_id", "host", "path", "action"]
        rows = (row for batch in batches for row in zip(*[batch.column(n).to_pylist() for n in names]))
        schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
        out: list[tuple] = []
        for row in sweep(rows):
            out.append(row)
            if len(out) == 20_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    done = placed.mapInArrow(judged, "page_id bigint, host string, path string, rule string, verdict string")
    return done.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _dealer(points: list[str]):
    """Adds the range: one for a page, all that its interval meets for a rule. Pages whose key is a split point itself
    are spread over all ranges that begin or end there."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pages, spreads = (batch.column(n).to_pylist() for n in ("key", "is_page", "spread"))
            rows, ranges = [], []
            for i, (key, is_page, spread) in enumerate(zip(keys, pages, spreads)):
                first = bisect_left(points, key)
                if is_page:
                    last = bisect_right(points, key)
                    ranges.append(first + spread % (last - first + 1))
                    rows.append(i)
                    continue
                # keys that start with this one end before the same key with its last dot raised
                last = bisect_right(points, key[:-1] + "/") if key else len(points)
                ranges += range(first, last + 1)
                rows += [i] * (last - first + 1)
            kept = batch.take(pa.array(rows, pa.int64())).drop_columns(["spread"])
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *kept.columns], names=["range", *kept.schema.names])

    return dealt
