"""Classifier and rule ledger against brute force."""

import re
import zlib
from collections import Counter

import pytest

from casemill.llm import quality, subword

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \t\n", "a b c a b c", "one two three " * 30, "word. " * 60, "A B\nA B\n\nA B \nx", "ÄÖ€ 😀 é", "x#y $ % & | < > *",
    "\n".join(["same line here"] * 5), "LOUD " * 80, " ".join(f"w{i}" for i in range(80)), "a" * 5000, " ".join(f"word{i}x" for i in range(3000)),
]


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_ledger_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s", 9), (None, "x", None, 1)],
                                 "doc_id long, text string, source string, failed int")  # a clashing name
    rows = quality.ledger(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "x" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(text), text
        assert bool(r.failed & quality.BASE.mask) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_policies_and_ablations(spark):
    bits = [0, 0, 1, 2, 3, 4, 4, 5]
    book = spark.createDataFrame([(i, "s", b) for i, b in enumerate(bits)], "doc_id long, source string, failed long")
    kept = {r.doc_id for r in quality.verdicts(book, quality.BASE).filter("kept").collect()}
    assert kept == {i for i, b in enumerate(bits) if not b & 3}
    found = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(book, quality.V1).collect()}
    for i, rule in enumerate(quality.RULES):
        assert found[rule] == (sum(bool(b & 1 << i) for b in bits), sum(b == 1 << i for b in bits), sum(b in (0, 1 << i) for b in bits))
    total = quality.combined(book, "source").first()
    assert (total.any_failed, total.all_failed, total.n) == (7, 0, 8)
    empty = {r.n_failed for r in quality.ablations(book.limit(0), quality.V1).collect()}
    assert empty == {0}


def test_features_count_every_ngram():
    words = ["a", "née", "longer", "x" * 40]
    rows, owners = subword.word_features(words, 1 << 20)
    for i, w in enumerate(words):
        marked = f"<{w}>"
        assert (owners == i).sum() == 1 + sum(max(len(marked) - n + 1, 0) for n in (3, 4, 5))
    alone, _ = subword.word_features(["née"], 1 << 20)
    assert sorted(alone) == sorted(rows[owners == 1])  # neighbours do not matter


def test_classifier_learns_and_scores_everything(spark):
    good = [(i, f"the plain report number {i} says what was found and why it matters") for i in range(60)]
    bad = [(100 + i, f"buy!!! now### cheap$$$ {i} " * 3) for i in range(60)]
    docs = spark.createDataFrame(good + bad + [(500, None), (501, ""), (None, "the plain report"), (0, "buy!!! cheap$$$ now###")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (7, None, 0), (8, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    model = subword.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = subword.classify(docs, model, 0.3).collect()
    assert len(rows) == 124 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id not in (None, 0, 500, 501) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.predicted == (r.doc_id < 100) for r in held)
    assert subword.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0).folded.tolist() == model.folded.tolist()


@pytest.mark.parametrize("given", [[], [(1, 1, 0)]])
def test_classifier_without_both_labels(spark, given):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = subword.train(docs, spark.createDataFrame(given, "doc_id long, quality int, toxic int"), F.lit(True))
    assert len({r.score for r in subword.classify(docs, model, 0.3).collect()}) == 1
    assert subword.classify(docs.limit(0), model, 0.3).count() == 0
