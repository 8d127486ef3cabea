"""Metrics, bootstrap, ranking, answers and the classifier against brute force."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.operators import answers as A
from casemill.operators import bm25, bootstrap, classifier, dense, fusion
from casemill.operators import metrics as M
from casemill.operators.labels import pos_weights


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i:02d}", m, s, int(y), float(np.round(min(1.0, max(0.0, 0.6 * y + rng.uniform(0, 0.5))), 3)))
            for i in range(30) for s, y in (("a", i % 2), ("b", i % 5 == 0), ("rare", i == 0)) for m in ("x", "z")]
    return spark.createDataFrame(rows, "case_no string, model string, series string, y int, p double").cache(), rows


def _macro(rows, model, weights, classes):
    out = []
    for s in classes:
        tp = sum(weights[c] for c, m, t, y, p in rows if m == model and t == s and y and p >= 0.5)
        fp = sum(weights[c] for c, m, t, y, p in rows if m == model and t == s and not y and p >= 0.5)
        fn = sum(weights[c] for c, m, t, y, p in rows if m == model and t == s and y and p < 0.5)
        out.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
    return sum(out) / len(out)


def test_macro_and_bootstrap_match_brute_force(spark, predictions):
    df, rows = predictions
    ones = {r[0]: 1 for r in rows}
    macro = {r.model: r for r in M.macro_f1(M.class_scores(df)).collect()}
    for m in ("x", "z"):
        assert macro[m].macro_f1 == pytest.approx(_macro(rows, m, ones, ["a", "b", "rare"]))
        assert macro[m].supported_classes == 1  # only "a" has ten cases
    got = {(r.rep, r.model): r for r in bootstrap.resampled_macro_f1(df, 3, seed=5).collect()}
    outcomes = {c: sorted(f"{m}\x1f{s}\x1f{'tp' if y and p >= .5 else 'fp' if p >= .5 else 'fn'}" for n, m, s, y, p in rows if n == c and (y or p >= .5))
                for c in ones}
    names = sorted(ones, key=lambda c: "\x1e".join(outcomes[c]))
    for rep in range(3):
        weights = dict.fromkeys(names, 0) | Counter(names[i] for i in bootstrap.draws(rep, 0, 30, 30, 5).tolist())
        assert sum(weights.values()) == 30
        for m in ("x", "z"):
            assert got[rep, m].macro_f1 == pytest.approx(_macro(rows, m, weights, ["a", "b", "rare"]))
            assert got[rep, m].macro_f1_supported == pytest.approx(_macro(rows, m, weights, ["a"]))
    for block, at_once, per_row in ((3, 1000, 1000), (65_536, 7, 40), (4, 5, 11)):  # many blocks of patterns, many ranges of draws
        again = {(r.rep, r.model): r for r in bootstrap.resampled_macro_f1(df, 3, 5, block=block, at_once=at_once, per_row=per_row).collect()}
        assert again == got
    row = {r.name: r for r in bootstrap.intervals(bootstrap.resampled_macro_f1(df, 3, seed=5), [("x", "z")]).collect()}
    assert row["x minus z"].value == pytest.approx(macro["x"].macro_f1 - macro["z"].macro_f1)


def test_calibration_bounds(predictions):
    df, _ = predictions
    table = M.reliability(df)
    assert {r.bin for r in table.collect()} <= set(range(10))
    assert all(0 <= r.ece <= 1 for r in M.expected_calibration_error(table).collect())


def test_small_scores(spark):
    pairs = spark.createDataFrame([("x", "x"), ("y", "y"), ("x", "x")], "a string, b string")
    same = M.cohen_kappa(pairs, "a", "b").first()
    assert same.agreement == 1 and same.kappa == 1
    one_label = M.cohen_kappa(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b").first()
    assert one_label.kappa is None
    check = spark.createDataFrame([("A|B", "A|B|C", " y"), ("A", "Z", "")], "doc_rules string, true_rules string, checked string")
    row = M.hand_check_scores(check).first()
    assert (row.precision, row.recall, row.verdict) == (1.0, 2 / 3, "FAIL")
    y = spark.createDataFrame([("s", 1)] * 25 + [("s", 0)] * 75 + [("t", 1)] * 9, "series string, y int")
    assert {r.series: r.weight for r in pos_weights(y).collect()} == {"s": pytest.approx(math.sqrt(3)), "t": 1.0}
    best = M.best_configuration(spark.createDataFrame([("v2", 0.5), ("v1", 0.5)], "c string, s double"), "c", "s").first()
    assert best.c == "v1"
    assert [r.month for r in M.gaps_by_month(spark.createDataFrame([("2024-02",)], "month string"), "2024-01", "2024-03").orderBy("month").collect()] == ["2024-01", "2024-03"]


def _book(spark, n=60, width=6, seed=1):
    rng = np.random.default_rng(seed)
    words = ["supervise", "branch", "records", "books", "testimony", "margin", "notes", "the", "of"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(n)]
    vectors = np.round(rng.normal(size=(n, width)), 2)
    vectors[7] = vectors[3]  # a tie
    rules = [f"{1000 + 10 * (i % 17) if i % 4 else 9000 + i}.{i % 3:02d}" for i in range(n)]
    book = spark.createDataFrame([(i, rules[i], "t", texts[i], [float(x) for x in vectors[i]]) for i in range(n)],
                                 "chunk_id long, rule_no string, title string, text string, embedding array<float>").repartition(5).cache()
    asked = [("q0", "supervise the branch", vectors[3]), ("q1", "unheard words", vectors[9]), ("q2", "books books records notes margin", -vectors[5])]
    queries = spark.createDataFrame([(q, t, [float(x) for x in v]) for q, t, v in asked], "q string, text string, embedding array<float>").cache()
    return book, queries, texts, vectors.astype(np.float32).astype(float), rules, asked


def _brute(texts, vectors, rules, asked, k, conduct):
    n, stop = len(texts), {"the", "of"}
    toks = [[w for w in t.split() if w not in stop] for t in texts]
    mean = sum(map(len, toks)) / n
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q, text, v in asked:
        v = np.asarray(v, np.float32).astype(float)
        bm = np.zeros(n)
        for w in set(text.split()) - stop:
            for i, t in enumerate(toks):
                if w in t:
                    bm[i] += t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
        de = np.round(unit @ (v / np.linalg.norm(v)), 9)
        bm = np.round(bm, 9)
        hy = np.zeros(n)
        for s in (bm, de):
            hy[np.argsort(-s, kind="stable")] += 1 / (60 + np.arange(1, n + 1))
        for name, s in (("bm25", bm), ("dense", de), ("hybrid", np.round(hy, 12))):
            seen = []
            for j in np.argsort(-s, kind="stable"):
                base = rules[j].split(".")[0]
                if (conduct and int(base) >= 9000) or base in [b for b, _ in seen]:
                    continue
                seen.append((base, int(j)))
            out[name, q] = seen[:k]
    return out


@pytest.mark.parametrize("k", [1, 7, 500])
def test_best_documents_are_those_of_all_scores(spark, k):
    book, queries, *_ = _book(spark)
    # repeated rows are one document of twice the terms, as in the scores
    docs = book.select("chunk_id", "text").unionByName(book.select("chunk_id", "text").limit(3))
    index = bm25.build_index(docs, "chunk_id", F.col("text"))
    best = {}
    for r in index.scores(queries, "q", F.col("text")).collect():
        best.setdefault(r.q, []).append((-r.score, r.chunk_id))
    want = sorted((q, c, -s, n + 1) for q, rows in best.items() for n, (s, c) in enumerate(sorted(rows)[:k]))
    top = index.top(queries, "q", F.col("text"), k)
    assert sorted(tuple(r) for r in top.select("q", "chunk_id", "score", "rank").collect()) == want
    # term rows are shuffled by document and the best rows by query, never pairs of both
    shuffled = re.findall(r"Exchange hashpartitioning\(([^)]*)", top._jdf.queryExecution().executedPlan().toString())
    by = [re.findall(r"(\w+)#", keys) for keys in shuffled]
    assert ["chunk_id"] in by and ["q"] in by and ["q", "chunk_id"] not in by


@pytest.mark.parametrize("conduct,k", [(False, 5), (True, 3), (True, 40)])
def test_rankings_match_brute_force(spark, conduct, k):
    book, queries, texts, vectors, rules, asked = _book(spark)
    want = _brute(texts, vectors, rules, asked, k, conduct)
    index = bm25.build_index(book.select("chunk_id", "text"), "chunk_id", F.col("text"))
    scores = index.scores(queries, "q", F.col("text"))
    lists = {"bm25": fusion.top_rules(scores, book, queries, "q", k, conduct), "dense": fusion.dense_rules(book, queries, "q", k, conduct),
             "hybrid": fusion.hybrid_rules(scores, book, queries, "q", k, conduct)}
    # the path of queries whose top is filled by one rule
    lists["whole"] = fusion.hybrid_rules(scores, book, queries, "q", k, conduct, max_depth=0)
    for key, df in lists.items():
        got, name = {}, "hybrid" if key == "whole" else key
        for r in df.orderBy("q", "rank").collect():
            got.setdefault((name, r.q), []).append((r.rule, r.chunk_id))
        assert got == {key: v for key, v in want.items() if key[0] == name}


def test_tiles_change_nothing(spark, monkeypatch):
    book, queries, *_ = _book(spark)
    one = sorted(dense.nearest(book, queries, "chunk_id", "q").collect())
    book = book.withColumn("rule", F.pmod(F.xxhash64("chunk_id"), F.lit(3)))
    by_rule = sorted(dense.nearest(book, queries, "chunk_id", "q", 2, group="rule").collect())
    monkeypatch.setattr(dense, "QUERY_TILE", 1)
    monkeypatch.setattr(dense, "CHUNK_TILE", 2)
    assert sorted(dense.nearest(book, queries, "chunk_id", "q").collect()) == one
    assert sorted(dense.nearest(book, queries, "chunk_id", "q", 2, group="rule").collect()) == by_rule
    assert dense.nearest(book, queries.limit(0), "chunk_id", "q").count() == 0 == dense.nearest(book.limit(0), queries, "chunk_id", "q").count()


def test_answers(spark):
    raw = spark.createDataFrame([
        ("a1", False, "3110.01|4511", json.dumps([{"rule": "FINRA Rule 3110(a)", "reason": "x"}, {"rule": "9999", "reason": "made up"}, {"rule": "none", "reason": "y"}])),
        ("a2", True, "8210", json.dumps([{"rule": "8210", "reason": "z"}])), ("a3", False, "4511", "[]"), ("a4", False, "4511", None),
    ], "item_id string, decline boolean, chunk_rules string, reasons string")
    got = {r.item_id: (r.decline, r.rules, r.outside) for r in A.answered(raw).collect()}
    assert got == {"a1": (False, "3110", 1), "a2": (True, "", 0), "a3": (True, "", 0), "a4": (True, "", 0)}
    hand = spark.createDataFrame([("1", "Correct "), ("2", "")], "case_no string, label string")
    with pytest.raises(ValueError, match="'2'"):
        A.require_labels(hand, "case_no")


def test_classifier_separates_topics(spark):
    docs = spark.createDataFrame([(i, "failed to supervise the branch office" if i % 2 else "unsuitable leveraged fund sales " * 2, i % 2, 1 - i % 2) for i in range(40)],
                                 "doc_id long, text string, sup int, suit int")
    tfidf = classifier.fit_tfidf(docs, "doc_id", "text")
    terms = {r.term: r for r in tfidf.terms.collect()}
    assert terms["supervise"].idf == pytest.approx(math.log(41 / 21) + 1) and "branch office" in terms
    vectors = tfidf.vectors(docs, "doc_id", "text")
    assert sum(x * x for x in vectors.first().features.weight) == pytest.approx(1)
    models = classifier.fit_labels(vectors, ["sup", "suit"], tfidf.size)
    rows = classifier.predict_labels(models, vectors, "doc_id", "m").collect()
    assert len(rows) == 80 and all((r.p >= 0.5) == ((r.doc_id % 2 == 1) == (r.series == "sup")) for r in rows)


def test_constant_labels_are_predicted_as_they_are(spark):
    rows = [(i, "sold notes" if i % 2 else "kept books", i % 2, 1, 0, None) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mixed int, always int, never int, unknown int")
    tfidf = classifier.fit_tfidf(docs, "doc_id", "text")
    vectors = tfidf.vectors(docs, "doc_id", "text")
    models = classifier.fit_labels(vectors, ["mixed", "always", "never", "unknown"], tfidf.size)
    got = {(r.doc_id, r.series): r.p for r in classifier.predict_labels(models, vectors, "doc_id", "m").collect()}
    assert len(got) == 48
    for i in range(12):
        assert got[i, "always"] == 1.0 and got[i, "never"] == got[i, "unknown"] == 0.0
        assert (got[i, "mixed"] > 0.5) == bool(i % 2)


def test_labels_are_trained_together_as_one_by_one(spark, monkeypatch):
    """Coefficients against a regression of Spark's library, and the passes of many labels against those of one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    from casemill.operators import regression
    rng = random.Random(4)
    rows = []
    for i in range(120):
        at = sorted(rng.sample(range(9), rng.randint(0, 5)))
        rows.append((i, (at, [rng.random() for _ in at]), int((3 in at) != (rng.random() < 0.2)), int(rng.random() < 0.1 + 0.4 * (5 in at)), None if i % 7 else 1))
    vectors = spark.createDataFrame(rows, "doc_id long, features struct<index: array<int>, weight: array<double>>, a int, b int, c int").repartition(3)
    passes = []
    whole = regression._pass
    monkeypatch.setattr(regression, "_pass", lambda *x: passes.append(x[3]) or whole(*x))
    monkeypatch.setattr(regression, "SLICE", 4)
    (group,) = classifier.fit_labels(vectors, ["a", "b", "c"], 9)
    most = len(passes)
    passes.clear()
    monkeypatch.setattr(regression, "COEFFICIENTS", 10)
    apart = classifier.fit_labels(vectors, ["a", "b", "c"], 9)
    assert [g.names for g in apart] == [["a"], ["b"], ["c"]] and most == max(sum(p == [i] for p in passes) for i in range(3)) < len(passes)
    for i, label in enumerate("abc"):
        assert apart[i].points[0] == pytest.approx(group.points[i], abs=1e-4)
        y = {r[0]: r[2 + i] or 0 for r in rows}
        pos = sum(y.values())
        given = spark.createDataFrame([(Vectors.sparse(9, *r[1]), float(y[r[0]]), 60 / pos if y[r[0]] else 60 / (120 - pos)) for r in rows], ["features", "label", "w"])
        want = LogisticRegression(weightCol="w", regParam=1 / 480, standardization=False, tol=1e-10, maxIter=500).fit(given)
        assert [*want.coefficients, want.intercept] == pytest.approx(list(group.points[i]), abs=2e-3)
    p = {(r.doc_id, r.series): r.p for r in classifier.predict_labels([group], vectors, "doc_id", "m").collect()}
    again = {(r.doc_id, r.series): r.p for r in classifier.predict_labels(apart, vectors, "doc_id", "m").collect()}
    assert len(p) == 360 and p == pytest.approx(again, abs=1e-4)


def test_bm25_top_of_many_copies(spark):
    """Copies tie and the smallest ids win, over tasks and blocks of sets; queries of the same words get the same rows."""
    texts = ["alpha beta", "alpha gamma gamma", "beta delta", "epsilon", ""]
    docs = spark.createDataFrame([(i, texts[i * 7 % 5]) for i in range(3000)], "id long, text string").repartition(3, "text")
    asks = ["alpha beta", "beta alpha beta", "gamma", "none", "epsilon delta", "delta", ""]
    queries = spark.createDataFrame(list(enumerate(asks)), "q int, ask string")
    index = bm25.build_index(docs, "id", F.col("text"))
    scores = index.scores(queries, "q", F.col("ask")).collect()
    expected = {}
    for r in sorted(scores, key=lambda r: (r.q, -r.score, r.id)):
        expected.setdefault(r.q, []).append((r.id, r.score))
    expected = sorted((q, i, s, at) for q, best in expected.items() for at, (i, s) in enumerate(best[:4], 1))
    for top in (bm25.search_top(docs, "id", F.col("text"), queries, "q", F.col("ask"), 4), index.top(queries, "q", F.col("ask"), 4)):
        assert sorted(map(tuple, top.collect())) == expected
        assert "MapInArrow" in top._jdf.queryExecution().toString()  # no rows of query and document
    assert len(expected) == 20


def test_descent_needs_few_passes():
    """Many columns of unequal weight: the remembered steps keep the number of passes low."""
    from casemill.operators import regression
    rng = np.random.default_rng(5)
    x = rng.random((300, 400)) * (rng.random((300, 400)) < 0.05) * np.logspace(0, -2, 400)
    x[:, 0] = 1
    y = (x[:, 1:40].sum(axis=1) + 0.05 * rng.standard_normal(300) > np.median(x[:, 1:40].sum(axis=1))).astype(float)
    descent, passes = regression.Descent(400), 0
    while not descent.done and passes < 500:
        p = 0.5 * (1 + np.tanh(0.5 * (x @ descent.trial)))
        loss = np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ descent.trial))) + 0.5 * 1e-4 * descent.trial @ descent.trial
        descent.told(loss, x.T @ (p - y) / 300 + 1e-4 * descent.trial)
        passes += 1
    assert descent.done and np.abs(descent.gradient).max() <= descent.goal
    assert passes < 80
