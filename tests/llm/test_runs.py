"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from casemill.llm import runs
from casemill.llm.queries import op13_runs


def brute(words):
    """(start, period, length) of all runs."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = max(i + 1, j)
    return sorted((s, p, length) for (s, length), p in found.items())


def periodic(rng):
    kinds, n = rng.randint(1, 3), rng.choice([0, 1, 5, 6, 7, 30, 100, 300])
    text = [rng.randrange(kinds) for _ in range(n)]
    if n > 10 and rng.random() < .6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        text = [text[i] if i < a else text[a + (i - a) % p] for i in range(n)]
    return text


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(5)
    for pairs in (1_000_000, 50):
        monkeypatch.setattr(runs, "PAIRS", pairs)
        for _ in range(60):
            texts = [periodic(rng) for _ in range(rng.randint(1, 12))]
            text, start, length, period = runs.runs([np.array(t, dtype=np.int64) for t in texts])
            for n, words in enumerate(texts):
                mine = text == n
                assert list(zip(start[mine].tolist(), period[mine].tolist(), length[mine].tolist())) == brute(words), words


def test_extensions_with_other_covers(monkeypatch):
    rng = random.Random(6)
    for v, cover in ((3, (0, 1)), (7, (0, 1, 3)), (13, (0, 1, 3, 9)), (21, (0, 1, 4, 14, 16))):
        monkeypatch.setattr(runs, "V", v)
        monkeypatch.setattr(runs, "COVER", cover)
        text = periodic(rng) + [0, 1] * 40 + periodic(rng)
        line = np.array([-1, *text, -2])
        common = runs.Extensions(line)
        assert len(common.at) <= len(line) * len(cover) / v + len(cover)
        pairs = [(i, j) for i in range(1, len(text) + 1) for j in (rng.randrange(1, len(text) + 1),) if i != j]
        got = common(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
        for (i, j), length in zip(pairs, got.tolist()):
            want = 0
            while line[i + want] == line[j + want]:
                want += 1
            assert want == length


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, p, length in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    lines = "".join(f"{s},{length},{p}\n" for s, p, length in found)
    tail = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (len(found), *tail, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r.doc_id: tuple(r[c] for c in names) for r in op13_runs(spark, folder).collect()}
    want = {r.doc_id: expected(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert got == want and any(v[1] is not None for v in want.values())


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(1, None), (None, "a a a a a a b"), (2, ""), (2, " \n "), (3, "x " * 40_000), (4, "p q r " * 9 + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS collapsed")
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in runs.collapse(docs).collect())
    assert got == [(0, [(0, 6, 1)], "a b"), (1, [], ""), (2, [], ""), (2, [], ""), (3, [(0, 40_000, 1)], "x"), (4, [(0, 27, 3)], "p q r z")]
    assert runs.collapse(docs.limit(0)).count() == 0
