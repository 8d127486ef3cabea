"""SimHash near duplicates: 64-bit fingerprints of word shingles, linked by BK-trees.

Equal fingerprints meet first, so a tree never sees copies. Two fingerprints at two or fewer differing bits agree in at
least six of their eight bytes. Each fingerprint is therefore sent to 28 shards, one for each choice of six bytes, and a
shard holds at most 65,536 fingerprints, as only 16 bits are left: a proven bound for the tree that is built and queried
there, whatever the input. In the tree, children are keyed by their Hamming distance to the parent, and a query follows
only edges within the radius of its own distance. A shard reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from casemill.llm import resemblance
from casemill.llm.components import components
from casemill.sources.session import written

RADIUS = 2
SHINGLE = 3
SEED = 42
KEPT_BYTES = 8 - RADIUS
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
BLOCK = 200_000


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number; zero for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    last = max(len(words) - SHINGLE, 0)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:last]]
    stops = ends[min(SHINGLE, len(words)) - 1:]
    hashed = xxhash.xxh64_intdigest
    total, ones = last + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, total, BLOCK):
        values = np.array([hashed(joined[a:b - 1], SEED) for a, b in zip(starts[at:at + BLOCK], stops[at:at + BLOCK])], dtype="<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``radius`` among distinct numbers, by one BK-tree."""
    children: list[dict[int, int]] = []
    above = list(range(len(values)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    links = []
    for i, value in enumerate(values):
        open_nodes = [0] if i else []
        while open_nodes:  # links to what the tree holds so far
            node = open_nodes.pop()
            apart = (value ^ values[node]).bit_count()
            if apart <= radius and (a := top(i)) != (b := top(node)):
                above[max(a, b)] = min(a, b)
                links.append((values[node], value))
            open_nodes += [c for d in range(apart - radius, apart + radius + 1) if (c := children[node].get(d)) is not None]
        children.append({})
        node = 0
        while i:  # then the value takes its place
            apart = (value ^ values[node]).bit_count()
            if (below := children[node].get(apart)) is None:
                children[node][apart] = i
                break
            node = below
    return links


def shards(prints: DataFrame) -> DataFrame:
    """``members``: the fingerprints of each shard that has at least two; at most 65,536 each."""
    masks = [sum(0xFF << 8 * b for b in kept) for kept in combinations(range(8), KEPT_BYTES)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
                              for i, m in enumerate(signed)])).alias("key")
    return (prints.select("fp", key).groupBy("key.mask", "key.part").agg(F.collect_list("fp").alias("members"))
            .filter(F.size("members") > 1).select("members"))


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a, b`` among distinct fingerprints ``fp`` that connect all that are linked, directly or through others."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [e for members in pdf.members for e in forest([int(v) & 0xFFFFFFFFFFFFFFFF for v in members], RADIUS)]
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return shards(prints).mapInPandas(search, "a bigint, b bigint")


def groups(prints: DataFrame) -> DataFrame:
    """``fp, root`` for every distinct fingerprint of ``prints(fp)``: fingerprints with one root are one group."""
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # one row becomes 28, so not in a few tasks
    distinct = written(prints.select("fp").distinct().repartition(tasks, "fp"))
    found = components(links(distinct))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of the documents, repeated rows included.

    Null and empty texts have fingerprint zero and are one group. ``component_id`` is the smallest id of the group that
    is not null; it is null only if every id of the group is. An empty table gives no rows.
    """
    rows = written(docs.select("doc_id", fingerprint("text").alias("fp")))
    smallest = rows.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    roots = written(groups(rows))
    ids = roots.join(smallest, "fp").groupBy("root").agg(F.min("smallest").alias("component_id"))
    of = roots.join(ids, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (``resemblance``: five-word shingles, similarity 0.8), with all columns of
    ``docs``: the smallest id (nulls last), then the smallest digest.

    Of rows equal in both, one stays. Null and empty texts are one group.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # nested, so no column name can clash
    marked = written(docs.select(whole, F.col("doc_id").alias("key"), resemblance.entry("text").alias("e")).select("row", "key", "e.*"))
    ids = marked.groupBy("copy", "key").agg(F.count("*").alias("n"))
    roots = resemblance.groups(marked.select("copy", "n", "keys", "mark", "print", "row.text"))
    placed = written(ids.join(roots, "copy"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "copy")).alias("first"))
    judged = written(placed.join(first, "root").select("copy", "key", "n", (
        (F.col("copy") == F.col("first.copy")) & F.col("key").eqNullSafe(F.col("first.key"))).alias("kept")))

    def of(some: DataFrame) -> Column:
        return (marked["copy"] == some["_copy"]) & marked["key"].eqNullSafe(some["_key"])

    # rows that stay as they are need not move: only what goes and what is there twice is looked up
    named = judged.select(F.col("copy").alias("_copy"), F.col("key").alias("_key"), "n", "kept")
    other, twice = written(named.filter("NOT kept OR n > 1")), named.filter("kept AND n > 1")
    once = marked.join(other, of(other), "left_anti").select("row")
    again = marked.join(twice, of(twice), "left_semi").groupBy("key", "copy").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
