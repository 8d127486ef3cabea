"""The conversation trie against brute force: every prefix counted on its own."""

import hashlib
import random
import zlib
from collections import defaultdict

from casemill.llm import threads
from casemill.llm.queries import op11_threads

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(conversations):
    """Node rows for {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[:len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode().split()) for p in below if p)
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children[path]),
                    sum(not children[p] for p in below), saved, hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


def conversations(rng, n):
    turns = [("user", w) for w in ("a", "b c", "d e f", "")] + [("assistant", "a")]
    out = {i: [rng.choice(turns) for _ in range(rng.choice((1, 1, 2, 3, 5)))] for i in rng.sample(range(-50, 4 * n), n)}
    chain = [rng.choice(turns) for _ in range(60)]
    for i, size in enumerate((60, 60, 59, 40, 58)):
        out[10_000 + i] = chain[:size] + [("user", "z")] * (i == 4)
    for i in range(40):  # a hot sequence
        out[20_000 + i] = [("user", "b c"), ("assistant", "a")]
    return out


def test_nodes_equal_brute_force_at_every_shard_size(spark):
    rng = random.Random(11)
    given = conversations(rng, 150)
    rows = [(c, i, role if role != "user" or rng.random() < .9 else "user", text) for c, turns in given.items() for i, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS path", "2 AS words").repartition(4)
    want = brute(given)
    for shard, fan in ((10**6, 256), (60, 256), (12, 3)):
        assert rows_of(threads.nodes(threads.sequences(table), shard, fan)) == want, (shard, fan)


def test_order_nulls_repeats_and_empty_table(spark):
    rows = [(1, 2, "user", "late"), (1, None, None, "first"), (1, 1, "user", None), (1, 1, "user", None), (None, 0, "user", "lost"), (2, 5, "", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = brute({1: [("", "first"), ("user", ""), ("user", ""), ("user", "late")], 2: [("", "first")]})
    assert rows_of(threads.nodes(threads.sequences(table))) == want
    assert rows_of(threads.nodes(threads.sequences(table.limit(0)))) == []


def test_double_array_holds_exactly_its_paths():
    rng = random.Random(4)
    digests = [hashlib.md5(bytes([i])).digest() for i in range(9)]
    paths = sorted({b"".join(rng.choices(digests, k=rng.randint(0, 6))) for _ in range(300)})
    trie = threads.DoubleArray(paths)
    prefixes = {p[:n] for p in paths for n in range(0, len(p) + 1, 16)}
    assert len(trie.order) == len(prefixes) == sum(c != -1 for c in trie.check)
    assert len({tuple(trie.walk(p)) for p in prefixes}) == len(prefixes)
    assert all(len(trie.walk(p)) == len(p) // 16 + 1 for p in prefixes)
    assert all(trie.walk(p + d)[-1] == trie.walk(p)[-1] for p in prefixes for d in digests if p + d not in prefixes)
    assert len(trie.check) < 2 * len(trie.order) + 9


def test_query_rebuilds_conversations(spark):
    folder = "/root/testdata/sf0.001"
    own = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        own[r.conv_id].append((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    rebuilt = {c: own.get(c - c % 20, [])[:h[c]] + turns[h[c]:] for c, turns in own.items()}
    assert rows_of(op11_threads(spark, folder)) == brute(rebuilt)
