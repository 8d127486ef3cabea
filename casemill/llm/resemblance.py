"""Near copies by resemblance: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Texts of the same words meet first. Each other text has a SimHash fingerprint of its shingles and 120 minimum hashes,
joined five at a time to 24 keys: two texts at 0.8 share no key with a chance of 7 in 100,000. Texts that share a key are
a shard, and BK-trees over its fingerprints find the candidates. A tree is rooted in the shard's most central text (whose
keys most texts share). First each text is compared with the nearest such root alone. Where a key still holds several
groups, its texts are sorted by their further keys and cut into trees of bounded size, and each text is compared with its
nearest few in other groups. The 120 hashes are compared first (16 bits each, at 0.65); what passes is compared on the
whole shingle sets.

What the trees left open is settled by ``rest``: where a key's texts are still in several groups, every text outside the
largest one is compared with every text of another group, a tile of texts with a tile of texts in one task. A pair is not a
row there, so rows and memory stay bounded; only the comparisons within tasks grow with texts outside times texts of the key.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, ShortType, StructField, StructType

from casemill.llm.components import components
from casemill.sources.session import written

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 24, 5
#: Neighbours that a text is compared with in an order, and least share of equal minimum hashes: four deviations below 0.8.
NEAR, PLAUSIBLE = 8, 0.65
#: Most differing bits of candidates: texts at 0.8 differ in 9.7 of 64 on average, in 12 if they have but a few shingles,
#: with a deviation of 3. Most fingerprints of a tree.
RADIUS, TREE = 24, 256
SEED, UNSIGNED = 43, (1 << 64) - 1
#: Shingles whose products are held at once.
BLOCK = 2_000
#: Texts whose sets a task hands on at once.
BATCH = 200
#: Orders of the trees. Texts and shingles of a tile, on average, and texts compared with a tile at once.
ORDERS, TILE, TILE_SHINGLES, ROW = 2, 512, 400_000, 32
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ENTRY = StructType([StructField("copy", LongType()), StructField("n", LongType()), StructField("keys", ArrayType(LongType())),
                    StructField("mark", ArrayType(ShortType())), StructField("print", LongType())])


def shingles_of(text: str | None) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and the different hashed shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in simhash.fingerprint_of
    joined = b" ".join(words)
    if not words:
        return joined, np.empty(0, dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, stops = [0, *ends[:max(len(words) - SHINGLE, 0)]], ends[min(SHINGLE, len(words)) - 1:]
    hashed = xxhash.xxh64_intdigest
    return joined, np.unique(np.array([hashed(joined[a:b - 1], SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


def entry_of(text: str | None) -> tuple[int, int, list[int], list[int], int]:
    """Digest of the words (zero without any), number of different shingles, keys, 16 bits of each minimum hash, and the
    fingerprint: a bit is 1 if set in over half the shingles' hashes."""
    copy, n, keys, mark, fingerprint = _hashes(text)
    return copy, n, keys.tolist(), mark.tolist(), fingerprint


def _hashes(text: str | None) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    joined, values = shingles_of(text)
    if not len(values):
        return 0, 0, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int16), 0
    least, ones = np.full(len(FACTORS), np.iinfo(np.uint64).max), np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), BLOCK):
        block = values[at:at + BLOCK]
        np.minimum(least, np.multiply.outer(FACTORS, block).min(axis=1), out=least)
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    keys = [xxhash.xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return (int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).view(np.int64)), len(values),
            np.array(keys, dtype=np.uint64).view(np.int64), (least >> np.uint64(8)).astype(np.uint16).view(np.int16),
            int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0]))


def entries(texts: pa.Array) -> pa.StructArray:
    """``entry_of`` of every text. A few texts are Python strings at a time, and the hashes are never Python numbers."""
    n = len(texts)
    copies, sizes, prints = (np.zeros(n, dtype=np.int64) for _ in range(3))
    ends = np.zeros(n + 1, dtype=np.int32)
    keys, marks, filled = np.empty((n, BANDS), dtype=np.int64), np.empty((n, BANDS * ROWS), dtype=np.int16), 0
    for at in range(0, n, BATCH):
        for i, text in enumerate(texts.slice(at, BATCH).to_pylist(), at):
            copies[i], sizes[i], key, mark, prints[i] = _hashes(text)
            if len(key):
                keys[filled], marks[filled] = key, mark
                filled += 1
            ends[i + 1] = filled
    lists = [pa.ListArray.from_arrays(pa.array(ends * x.shape[1]), pa.array(x[:filled].ravel())) for x in (keys, marks)]
    return pa.StructArray.from_arrays([pa.array(copies), pa.array(sizes), *lists, pa.array(prints)], names=ENTRY.names)


@F.arrow_udf(ENTRY)
def entry(texts: pa.Array) -> pa.Array:
    return entries(texts)


class Tree:
    """A BK-tree over unsigned 64-bit fingerprints: a node's children are keyed by their differing bits from it."""

    def __init__(self) -> None:
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, fingerprint: int) -> None:
        """The next number, counted from 0, stands for the fingerprint."""
        node, new = 0, len(self.prints)
        while new:
            apart = (fingerprint ^ self.prints[node]).bit_count()
            if (below := self.children[node].get(apart)) is None:
                self.children[node][apart] = new
                break
            node = below
        self.prints.append(fingerprint)
        self.children.append({})

    def near(self, fingerprint: int, radius: int, most: int, fits: Callable[[int], bool]) -> list[tuple[int, int]]:
        """``(differing bits, number)`` of the nearest fingerprints that fit, at most ``most``, within the radius."""
        found: list[tuple[int, int]] = []
        open_nodes = [0] if self.prints else []
        while open_nodes:
            node = open_nodes.pop()
            apart = (fingerprint ^ self.prints[node]).bit_count()
            limit = radius if len(found) < most else found[-1][0]
            if apart <= limit and fits(node):
                insort(found, (apart, node))
                del found[most:]
                limit = radius if len(found) < most else found[-1][0]
            open_nodes += [c for d, c in self.children[node].items() if abs(d - apart) <= limit]
        return found


@lru_cache(maxsize=16)
def _set_of(text: str) -> np.ndarray:
    return shingles_of(text)[1]


def alike(x: str, y: str) -> bool:
    """Whether the two texts' whole shingle sets are similar enough."""
    num, den = SIMILAR
    one, other = _set_of(x), _set_of(y)
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both * (num + den) >= (len(one) + len(other)) * num


def similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose texts in ``known(copy, text)`` are similar enough. Texts are moved, not their sets:
    these are larger and no codec makes them smaller."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                kept = pa.array(list(map(alike, part.column("x").to_pylist(), part.column("y").to_pylist())), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(c).filter(kept) for c in "ab"], names=["a", "b"])

    x = known.select(F.col("copy").alias("a"), F.col("text").alias("x"))
    y = known.select(F.col("copy").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compared, "a bigint, b bigint")


def plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose minimum hashes agree often enough."""
    x = marks.select(F.col("copy").alias("a"), F.col("mark").alias("x"))
    y = marks.select(F.col("copy").alias("b"), F.col("mark").alias("y"))
    same = F.size(F.filter(F.zip_with("x", "y", lambda u, v: u == v), lambda e: e))
    return pairs.join(x, "a").join(y, "b").filter(same >= PLAUSIBLE * BANDS * ROWS).select("a", "b")


def _most(turn: int) -> int:
    """How many neighbours a text looks at: none but the root at first, then twice as many in every second order."""
    return NEAR * (2 - turn % 2) if turn else 1


def candidates(members: DataFrame, turn: int) -> DataFrame:
    """``copy, aside, apart, other``: what trees over the fingerprints of each key's texts hold near a text, in other groups
    and of a size that may do. ``aside`` is 0 for the tree's root, else 1. The texts are sorted by the keys that follow; a range of the
    sorted rows is streamed into one tree after another, so no key is one task's."""
    num, den = SIMILAR
    names = ["key", "copy", "n", "print", "root", "hub", "hub_n", "hub_print", "hub_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, held = None, Tree(), []
        for batch in batches:
            found = []
            for key, copy, n, fingerprint, root, hub, hub_n, hub_print, hub_root in zip(*(batch.column(c).to_pylist() for c in names)):
                fingerprint, hub_print = fingerprint & UNSIGNED, hub_print & UNSIGNED
                if now != key or len(held) > TREE:
                    now, tree, held = key, Tree(), [(hub, hub_n, hub_root)]
                    tree.add(hub_print)
                if copy == hub:
                    continue

                def fits(i: int) -> bool:
                    return held[i][2] != root and min(n, held[i][1]) * den >= max(n, held[i][1]) * num

                near = tree.near(fingerprint, RADIUS, _most(turn), fits)
                far = (fingerprint ^ hub_print).bit_count()
                if far <= RADIUS and (far, 0) not in near and fits(0):
                    near.append((far, 0))
                found += [(copy, int(i > 0), apart, held[i][0]) for apart, i in near]
                tree.add(fingerprint)
                held.append((copy, n, root))
            columns = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))],
                                             names=["copy", "aside", "apart", "other"])

    ordered = members.select("order", *names).repartitionByRange("key", "order", "copy")
    return ordered.sortWithinPartitions("key", "order", "copy").select(*names).mapInArrow(
        run, "copy bigint, aside int, apart int, other bigint")


def nearest(found: DataFrame, turn: int) -> DataFrame:
    """``a, b``: of each text's ``candidates`` the nearest few, in the first turn the nearest root of a tree alone."""
    rank = F.struct("apart", "other") if turn else F.struct("aside", "apart", "other")
    picked = found.groupBy("copy").agg(F.explode(F.slice(F.sort_array(F.collect_set(rank)), 1, _most(turn))).alias("r"))
    return picked.select(F.least("copy", "r.other").alias("a"), F.greatest("copy", "r.other").alias("b")).distinct()


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each run of rows of one tile, with the places of the texts that ask and of those that are asked."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        tile = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        asks = np.asarray(tile.column("asks")).astype(bool)
        return tile, np.flatnonzero(asks), np.flatnonzero(~asks)

    now = None
    for batch in batches:
        ids = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "i", "j")], axis=1)
        ends = [*(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for low, high in zip([0, *ends], ends):
            if low == high:
                continue
            if held and now != ids[low].tolist():
                yield whole()
                held.clear()
            now = ids[low].tolist()
            held.append(batch.slice(low, high - low))
    if held:
        yield whole()


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of texts that may be similar to one on the tile's other side, in another group, by size and minimum hashes. A pair
    counts at the first of its shared keys alone."""
    num, den = SIMILAR
    for tile, a, b in _tiles(batches):
        copy, root, n = (np.asarray(tile.column(c)) for c in ("copy", "root", "n"))
        mark, keys = (np.asarray(tile.column(c).flatten()).reshape(tile.num_rows, -1) for c in ("mark", "keys"))
        used = np.zeros(tile.num_rows, dtype=bool)
        other = np.ascontiguousarray(mark[b].T)
        for at in range(0, len(a), ROW):
            part = a[at:at + ROW]
            equal = np.zeros((len(part), len(b)), dtype=np.uint8)
            for own, theirs in zip(mark[part].T, other):
                equal += own[:, None] == theirs
            one, two = n[part][:, None], n[b][None, :]
            may = (equal >= PLAUSIBLE * BANDS * ROWS) & (root[part][:, None] != root[b]) & (np.minimum(one, two) * den >= np.maximum(one, two) * num)
            x, y = np.nonzero(may)
            first = (keys[part[x]] == keys[b[y]]).argmax(axis=1)
            here = keys[part[x], first] == tile.column("key")[0].as_py()
            used[part[x[here]]] = used[b[y[here]]] = True
        kept = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([tile.column(c).take(pa.array(kept)) for c in ("key", "i", "j", "asks", "copy", "root")],
                                         names=["key", "i", "j", "asks", "copy", "root"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of texts of different groups, by their whole shingle sets: as many as join the groups that a tile's links join."""
    num, den = SIMILAR
    for tile, a, b in _tiles(batches):
        if not len(a) or not len(b):
            continue
        copy, root = np.asarray(tile.column("copy")), np.asarray(tile.column("root"))
        sets = [shingles_of(t)[1] for t in tile.column("text").take(pa.array(b)).to_pylist()]
        sizes = np.array([len(x) for x in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(b)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                x = y
            return x

        links = []
        for place, text in zip(a.tolist(), tile.column("text").take(pa.array(a)).to_pylist()):
            own = shingles_of(text)[1]
            low = np.searchsorted(values, own, "left")
            often = np.searchsorted(values, own, "right") - low
            at = np.repeat(low - np.r_[0, np.cumsum(often)[:-1]], often) + np.arange(often.sum())
            both = np.bincount(owner[at], minlength=len(b))
            for y in b[np.flatnonzero(both * (num + den) >= (len(own) + sizes) * num)].tolist():
                one, two = top(int(root[place])), top(int(root[y]))
                if one != two:
                    above[max(one, two)] = min(one, two)
                    links.append(sorted((int(copy[place]), int(copy[y]))))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])


def rest(now: DataFrame, facts: DataFrame, known: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the groups of ``now(key, copy, root)`` which any two similar texts of one key join.

    A key's largest group is only asked. Texts are dealt to blocks by their hash, and a block of those that ask and a block of
    all are a tile. Texts themselves are moved only where a tile has one that may be similar."""
    rows = now.join(facts.select("copy", "n"), "copy")
    own = rows.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    total = own.groupBy("key").agg(F.max(F.struct("m", "root", "s")).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("groups"))

    def blocks(m, s):
        return F.ceil(F.greatest(m / TILE, s / TILE_SHINGLES)).cast("int")

    sizes = written(total.filter("groups > 1").select("key", F.col("main.root").alias("main"), blocks(F.col("m"), F.col("s")).alias("asked"),
                                                      blocks(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("asking")))
    placed = now.join(sizes, "key")

    def dealt(asks: bool):
        mine, others = ("asking", "asked") if asks else ("asked", "asking")
        block = F.pmod(F.xxhash64("copy", F.lit(asks)), F.col(mine)).cast("int")
        side = placed.filter("root <> main") if asks else placed
        i, j = ("b", "o") if asks else ("o", "b")
        return side.select("key", "copy", "root", F.lit(asks).alias("asks"), block.alias("b"), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("o")).select(
            "key", F.col(i).alias("i"), F.col(j).alias("j"), "asks", "copy", "root")

    def by_tile(df: DataFrame) -> DataFrame:
        return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    schema = "key bigint, i int, j int, asks boolean, copy bigint, root bigint"
    asked = by_tile(dealt(True).unionByName(dealt(False)).join(facts.select("copy", "n", "keys", "mark"), "copy"))
    likely = written(asked.mapInArrow(_likely, schema))
    return written(by_tile(likely.join(known, "copy")).mapInArrow(_linked, "a bigint, b bigint"))


def groups(entries: DataFrame) -> DataFrame:
    """``copy, root`` for every different ``copy`` of ``entries(copy, n, keys, mark, print, text)``; one root is one group."""
    rows = entries.select("copy", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("copy").alias("low"), F.max("copy").alias("high")).filter("low <> high").select("key")
    members = written(rows.join(shared, "key").distinct())
    some = written(members.select("copy").distinct())
    # only texts that share a key are looked at further; one row of each copy leaves a task, however many there are
    facts = written(entries.select("copy", "n", "keys", "mark", "print").join(some, "copy", "left_semi").dropDuplicates(["copy"]))
    known = written(entries.select("copy", "text").join(some, "copy", "left_semi").groupBy("copy").agg(F.first("text").alias("text")))
    sizes = members.groupBy("key").agg(F.count("*").alias("members"))
    central = members.join(sizes, "key").groupBy("copy").agg(F.sum("members").alias("central"))
    weighed = central.join(facts.select("copy", "n", "print"), "copy")
    hubs = written(members.join(weighed, "copy").groupBy("key").agg(F.max(F.struct("central", "copy", "n", "print")).alias("h")).select(
        "key", F.col("h.copy").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.print").alias("hub_print")))
    edges = tried = some.limit(0).select(F.col("copy").alias("a"), F.col("copy").alias("b"))
    roots = components(edges)

    def placed() -> DataFrame:
        return members.join(roots.withColumnRenamed("node", "copy"), "copy", "left").withColumn("root", F.coalesce("root", "copy"))

    for turn in range(ORDERS):
        now = placed()
        apart = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        tops = apart.join(hubs, "key").join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").withColumn(
            "hub_root", F.coalesce("hub_root", "hub"))
        at = (F.array_position("keys", F.col("key")).cast("int") + 3 * turn) % BANDS
        order = F.concat(F.slice("keys", at + 1, F.lit(3)), F.slice("keys", F.lit(1), F.greatest(at + 3 - BANDS, F.lit(0))))
        left = now.join(tops, "key").join(facts.select("copy", "n", "print", "keys"), "copy").withColumn("order", order).drop("keys")
        asked = written(nearest(candidates(left, turn), turn).join(tried, ["a", "b"], "left_anti"))
        fresh = written(plausible(asked, facts))
        edges, tried = edges.unionByName(written(similar(fresh, known))), tried.unionByName(asked)
        roots = components(edges)
    found = rest(written(placed()), facts, known)
    if not found.isEmpty():
        roots = components(edges.unionByName(found))
    return entries.select("copy").distinct().join(roots.withColumnRenamed("node", "copy"), "copy", "left").select(
        "copy", F.coalesce("root", "copy").alias("root"))
