"""Prefix trie of conversations: double arrays per range of sequences, joined at the ranges' shared upper nodes.

A conversation is the sequence of its turns' digests (MD5 of role and text, 16 bytes; equal digests count as equal
turns). Sequences are sorted as bytes and cut into ranges (shards), so a node's members stand next to each other and only
the nodes on a shard's first and last path can reach into another shard. Each shard numbers its turns densely, packs BASE
and CHECK, walks its sequences through the arrays and closes every node that no other shard can know. The nodes left open
are merged with a stack, some hundred neighbouring shards a task, until one group is left.

Defined results: rows without a conversation id belong to none; turns are ordered by turn (nulls first), equal turn
numbers by digest; repeated rows are turns of their own; null roles and texts read as empty. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.sources.session import written

DIGEST = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a shard, shards that one task merges, and conversation ids joined to one row before they are hashed.
SHARD, FAN, CHUNK = 20_000, 256, 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """32 hex digits for a turn."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, path, words``: 32 hex digits a turn in ``path`` and each turn's number of words, from
    ``turns(conv_id, turn, role, text)``. Further columns are not read."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"), F.struct(
            "turn", digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.array_join("t.digest", "").alias("path"), F.col("t.words").alias("words"))


class DoubleArray:
    """A trie over dense turn ids: the child of slot s by id c is slot t = BASE[s] + c if CHECK[t] = s.

    Built level by level from sorted, distinct paths. Ids are given in the order in which levels meet new turns, so
    the ids of a node's children lie close together and children fit next to each other.
    """

    def __init__(self, paths: list[bytes]) -> None:
        self.paths = paths
        self.ids: dict[bytes, int] = {}
        self.base, self.check, self.digest, self.depth = [0], [-2], [b""], [0]
        self.free = 1
        #: Slots by level, parents before children.
        self.order = [0]
        queue = [(0, 0, len(paths))]
        for slot, low, high in queue:
            at = DIGEST * self.depth[slot]
            if low < high and len(paths[low]) == at:
                low += 1
            digests, ranges = [], []
            while low < high:
                turn, end = paths[low][at:at + DIGEST], low + 1
                while end < high and paths[end][at:at + DIGEST] == turn:
                    end += 1
                digests.append(turn)
                ranges.append((low, end))
                low = end
            if digests:
                for child, (first, end) in zip(self._add(slot, digests), ranges):
                    queue.append((child, first, end))

    def _add(self, slot: int, digests: list[bytes]) -> list[int]:
        ids = [self.ids.setdefault(d, len(self.ids)) for d in digests]
        check, low = self.check, min(ids)
        self._grow(self.free)
        while check[self.free] != -1:
            self.free += 1
            self._grow(self.free)
        at = self.free
        while True:
            base = at - low
            self._grow(base + max(ids))
            if all(check[base + i] == -1 for i in ids):
                break
            at += 1
        self.base[slot] = base
        children = [base + i for i in ids]
        for child, turn in zip(children, digests):
            check[child], self.digest[child], self.depth[child] = slot, turn, self.depth[slot] + 1
        self.order += children
        return children

    def _grow(self, slot: int) -> None:
        if (more := slot + 1 - len(self.check)) > 0:
            self.base += [0] * more
            self.check += [-1] * more
            self.digest += [b""] * more
            self.depth += [0] * more

    def child(self, slot: int, turn: int) -> int:
        """The child's slot, or -1."""
        at = self.base[slot] + turn
        return at if 0 <= at < len(self.check) and self.check[at] == slot else -1

    def walk(self, path: bytes) -> list[int]:
        """The slots from the root along a path, as far as the trie has it."""
        slots = [0]
        for at in range(0, len(path), DIGEST):
            turn = self.ids.get(path[at:at + DIGEST])
            slot = -1 if turn is None else self.child(slots[-1], turn)
            if slot < 0:
                break
            slots.append(slot)
        return slots


class Node:
    """A node that other shards may share: sums over its closed children, and what its own members give."""

    __slots__ = ("depth", "digest", "key", "words", "n_convs", "conv_id", "children", "leaves", "saved", "ends")

    def __init__(self, depth, digest, key, words, n_convs, conv_id, children, leaves, saved, ends) -> None:
        self.depth, self.digest, self.key, self.words, self.n_convs = depth, digest, key, words, n_convs
        self.conv_id, self.children, self.leaves, self.saved, self.ends = conv_id, children, leaves, saved, ends

    def add(self, other: Node) -> None:
        self.n_convs += other.n_convs
        self.conv_id = min(self.conv_id, other.conv_id)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends

    def close(self, parent: Node | None) -> tuple:
        """The finished row; what it adds to its parent is added."""
        leaves, saved = self.leaves or 1, self.saved + (self.n_convs - 1) * self.words
        if parent is not None:
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
        return (None, None, self.depth, self.digest, self.key, parent and parent.key, self.words, self.conv_id, None,
                self.n_convs, self.children, leaves, saved, self.ends or NOTHING)

    def row(self, segment: int, place: int) -> tuple:
        return (segment, place, self.depth, self.digest, self.key, None, self.words, self.conv_id, None, self.n_convs,
                self.children, self.leaves, self.saved, self.ends)


#: Open nodes carry the segment of shards that they come from and their place in it; finished ones have null there.
SCHEMA = ("segment bigint, place bigint, depth bigint, digest binary, key binary, parent_key binary, words bigint, "
          "conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
          "saved_tokens bigint, ends_sha256 string")
_ARROW = pa.schema([(c.split()[0], {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]])
                    for c in SCHEMA.split(", ")])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def shard_rows(paths: list[bytes], words: list[list[int]], convs: list[int], counts: list[int], ends: list[str],
               segment: int) -> Iterator[tuple]:
    """A shard's nodes: finished where no other shard can share them, else open. Paths are sorted and distinct."""
    if not paths:
        return
    trie = DoubleArray(paths)
    size = len(trie.check)
    n_convs, smallest, length = [0] * size, [0] * size, [0] * size
    end_of: dict[int, str] = {}
    first = last = [0]
    for i, path in enumerate(paths):
        slots = trie.walk(path)
        conv, n = convs[i], counts[i]
        for slot, w in zip(slots, [0, *words[i]]):
            if not n_convs[slot] or conv < smallest[slot]:
                smallest[slot] = conv
            n_convs[slot] += n
            length[slot] = w
        end_of[slots[-1]] = ends[i]
        if i == 0:
            first = slots
        last = slots
    open_slots = first + [s for s in last if s not in set(first)]
    is_open = set(open_slots)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for slot in reversed(trie.order):
        if slot in is_open:
            continue
        parent = trie.check[slot]
        leaves[slot] = leaves[slot] or 1
        saved[slot] += (n_convs[slot] - 1) * length[slot]
        children[parent] += 1
        leaves[parent] += leaves[slot]
        saved[parent] += saved[slot]
    keys: dict[int, bytes] = {}
    for path_slots in (first, last):
        hashed = hashlib.md5()
        for slot in path_slots:
            hashed.update(trie.digest[slot])
            keys[slot] = hashed.digest()
    for slot in trie.order:
        if slot in is_open:
            continue
        parent = trie.check[slot]
        yield (None, None, trie.depth[slot], trie.digest[slot], None, keys.get(parent), length[slot], smallest[slot],
               None if parent in is_open else smallest[parent], n_convs[slot], children[slot], leaves[slot], saved[slot],
               end_of.get(slot, NOTHING))
    for place, slot in enumerate(open_slots):
        yield Node(trie.depth[slot], trie.digest[slot], keys[slot], length[slot], n_convs[slot], smallest[slot],
                   children[slot], leaves[slot], saved[slot], end_of.get(slot)).row(segment, place)


def merged_rows(rows: Iterator[tuple[int, int, int, Node]], final: bool) -> Iterator[tuple]:
    """Open nodes ``(group, segment, place, node)`` in that order, merged per group.

    A segment lists its first path from the root and then what its last path does not share with it. The stack holds
    the open path; a node that leaves it is finished, unless it lies on the group's own first path.
    """
    group, start, stack, front = None, None, [], []

    def pop(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node, kept = stack.pop()
            if not kept:
                yield node.close(stack[-1][0] if stack else None)

    def finish() -> Iterator[tuple]:
        if final:
            yield from pop(0)
        else:
            tail = [node for node, kept in stack if not kept]
            for place, node in enumerate(front + tail):
                yield node.row(group, place)
        stack.clear()
        front.clear()

    for number, segment, place, node in rows:
        if number != group:
            if group is not None:
                yield from finish()
            group, start = number, segment
        if len(stack) > node.depth and stack[node.depth][0].digest == node.digest:
            stack[node.depth][0].add(node)
            continue
        yield from pop(node.depth)
        kept = not final and segment == start and place == node.depth
        stack.append((node, kept))
        if kept:
            front.append(node)
    if group is not None:
        yield from finish()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, conv_id) rows as rows of up to CHUNK ids of one path, joined by commas."""
    schema = pa.schema([("path", pa.binary()), ("words", pa.list_(pa.int32())), ("first", pa.int64()), ("n", pa.int64()),
                        ("ids", pa.string())])

    def rows() -> Iterator[tuple]:
        path, words, ids = None, None, []
        for batch in batches:
            for p, w, c in zip(*(batch.column(n).to_pylist() for n in ("path", "words", "conv_id"))):
                if ids and (p != path or len(ids) == CHUNK):
                    yield path, words, ids[0], len(ids), ",".join(map(str, ids))
                    ids = []
                path, words = p, w
                ids.append(c)
        if ids:
            yield path, words, ids[0], len(ids), ",".join(map(str, ids))

    yield from _batches(rows(), schema, 1000)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, words, convs, counts, ends, hashed = [], [], [], [], [], None
    for batch in batches:
        for p, w, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "first", "n", "ids"))):
            if paths and paths[-1] == p:
                hashed.update(b"," + ids.encode())
                counts[-1] += n
                continue
            if hashed is not None:
                ends.append(hashed.hexdigest())
            hashed = hashlib.sha256(ids.encode())
            paths.append(p)
            words.append(w)
            convs.append(first)
            counts.append(n)
    if hashed is not None:
        ends.append(hashed.hexdigest())
    yield from _batches(shard_rows(paths, words, convs, counts, ends, TaskContext.get().partitionId()), _ARROW)


def _merge(final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            names = ("group", "segment", "place", "depth", "digest", "key", "words", "n_convs", "conv_id", "n_children",
                     "n_leaves", "saved_tokens", "ends_sha256")
            for batch in batches:
                for group, segment, place, *node in zip(*(batch.column(n).to_pylist() for n in names)):
                    yield group, segment, place, Node(*node)
        yield from _batches(merged_rows(rows(), final), _ARROW)
    return run


def nodes(paths: DataFrame, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """The trie's nodes for ``paths(conv_id, path, words)``, one row per conversation as ``sequences`` gives them.

    ``conv_id`` is a node's smallest member, ``digest`` its last turn's digest (hex; root: empty), ``n_leaves`` and
    ``saved_tokens`` are sums over its subtree, ``ends_sha256`` covers the members that end in it, in numeric order.
    Members of one sequence are spread over tasks, joined to rows of ids, and only these rows are hashed in order.
    """
    rows = written(paths.select("conv_id", F.unhex("path").alias("path"), "words"))
    turns = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(1, -(-turns // shard))
    chunks = written(rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(
        _chunks, "path binary, words array<int>, first bigint, n bigint, ids string"))
    built = written(chunks.repartitionByRange(shards, "path").sortWithinPartitions("path", "first").mapInArrow(_shard, SCHEMA))
    finished = built.filter("segment IS NULL")
    left, shared = built.filter("segment IS NOT NULL"), None
    segments = built.agg(F.max("segment") + 1).first()[0] or 1
    while True:
        groups = -(-segments // fan)
        merged = written(left.withColumn("group", F.floor(F.col("segment") / fan)).repartition(groups, "group")
                         .sortWithinPartitions("group", "segment", "place").mapInArrow(_merge(groups == 1), SCHEMA))
        done = merged.filter("segment IS NULL")
        shared = done if shared is None else shared.unionByName(done)
        if groups == 1:
            break
        left, segments = merged.filter("segment IS NOT NULL"), groups
    whole = finished.unionByName(shared)
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
               F.lower(F.hex("digest")).alias("digest")]
    below = whole.filter("parent_key IS NOT NULL").join(parents, "parent_key").withColumn("parent_conv_id", F.col("above"))
    return whole.filter("parent_key IS NULL").select(*columns).unionByName(below.select(*columns))
