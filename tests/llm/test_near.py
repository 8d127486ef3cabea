"""Components, SimHash groups and vector links against brute force."""

import random

import numpy as np
import xxhash

from casemill.llm import simhash, vectors
from casemill.llm.components import components


def roots_of(nodes, edges):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    chain = list(range(1000, 1060))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(5, i) for i in range(6, 90)] + [(2, 2), (300, 301), (301, 300), (301, 302)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(None, 4)], "a long, b long")).collect()}
    want = roots_of({n for e in edges for n in e}, edges)
    del want[2]
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(len(words) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (None, "", " \n", "one", "one two", "One TWO three", "Été é É x y z", "a b c d e f a b c d e f", "x " * 500, "y\x0bz\x1cw\x85 v"):
        assert simhash.fingerprint_of(text) & (1 << 64) - 1 == brute_print(text), text


def test_trees_find_every_component():
    rng = random.Random(5)
    values = list({(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3)))) for base in [rng.getrandbits(64) for _ in range(20)] for _ in range(15)})
    want = roots_of(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= 2])
    assert roots_of(values, simhash.forest(values, 2)) == want


def test_groups_of_fingerprints(spark):
    rng = random.Random(9)
    values = {0}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(8):
            values.add(base)
            base ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)  # chains of links
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    rows = [(signed[v],) for v in values] + [(0,)] * 3
    got = {r.fp: r.root for r in simhash.groups(spark.createDataFrame(rows, "fp long")).collect()}
    want = roots_of(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    assert {frozenset(k for k in got if got[k] == r) for r in got.values()} == {frozenset(signed[v] for v in values if want[v] == r) for r in want.values()}


def test_documents(spark):
    long = " ".join(f"w{i % 97}v{i}" for i in range(400))
    rows = [(7, long), (3, long), (None, long), (9, long.upper()), (4, long + " tail"), (1, None), (2, ""), (5, "other words here"), (5, "other words here"), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS fp", "1 AS component_id", "2 AS `key`")
    got = sorted(simhash.near_duplicates(docs).collect(), key=str)
    assert len(got) == len(rows)
    prints = [brute_print(t) for _, t in rows]
    want = roots_of(set(prints), [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 2])
    ids = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            ids[want[p]] = min(i, ids.get(want[p], i))
    assert got == sorted([(i, f"{p:016x}", ids[want[p]]) for (i, _), p in zip(rows, prints)], key=str)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(ids.values())
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def brute_links(rows, threshold):
    def good(e, label):
        return label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)

    out = []
    for i, (_, e, le) in enumerate(rows):
        for j, (_, f, lf) in enumerate(rows):
            if i != j and good(e, le) and good(f, lf) and le == lf and len(e) == len(f):
                a, b = np.array(e, float), np.array(f, float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    out.append((i, j))
    return out


def test_quantised_bound_never_loses_a_pair():
    rng = np.random.default_rng(1)
    for size in (3, 64):
        a = rng.normal(size=(60, size)) * rng.uniform(1e-3, 1e3, (60, 1))
        b = np.vstack([a[:30] + rng.normal(size=(30, size)) * 0.3 * np.linalg.norm(a[:30], axis=1, keepdims=True) / size**0.5, rng.normal(size=(20, size))])
        cosine = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
        for threshold in (0.5, 0.93, 0.99):
            found = set(zip(*vectors.possible(a, b, threshold)))
            assert found >= set(zip(*np.nonzero(cosine >= threshold)))
            assert (vectors.linked(a, b, threshold) == (cosine >= threshold)).all()


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + rng.normal(size=8) * 0.12], i % 2) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (200, rows[0][1], 0), (None, rows[1][1], 1), (300, None, 1), (301, [0.0] * 8, 1), (302, [1.0, None], 1),
             (303, [float("nan")] * 8, 1), (304, [float("inf")] * 8, 1), (305, rows[2][1], None), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS n", "3 AS root")
    got = sorted(vectors.near_duplicates(table, 0.93, block=16).select("vec_id", "n_links", "component_id", "kept").collect(), key=str)
    links = brute_links(rows, 0.93)
    root = roots_of(range(len(rows)), links)
    want = []
    for i, (v, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        n, c = sum(a == i for a, _ in links), min(ids, default=None)
        want.append((v, n, c, n == 0 if v is None or c is None else v == c))
    assert got == sorted(want, key=str)
    assert vectors.near_duplicates(table.limit(0)).count() == 0
