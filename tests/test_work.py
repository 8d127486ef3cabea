"""Each step is worked out once, and only where a query needs it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casemill.functions import patterns
from casemill.operators import bootstrap, chunks, classifier, documents, fusion, regression
from casemill.queries import derived, pages, retrieval, text
from casemill.sources.tables import tasks

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_resample_makes_each_draw_once(monkeypatch):
    """However many blocks the cases stand in."""
    made, whole = [], bootstrap.draws
    monkeypatch.setattr(bootstrap, "draws", lambda rep, low, high, n, seed=0: made.append(high - low) or whole(rep, low, high, n, seed))
    given = pa.RecordBatch.from_pylist([{"rep": 0, "low": 0, "last": 2, "high": 100}])
    got = [r for b in bootstrap._counted(100, 7, 30, 8)(iter([given])) for r in b.to_pylist()]
    assert sum(made) == 200 and len(got) == 2 * 13
    for rep in (0, 1):
        often = np.concatenate([np.frombuffer(r["often"], dtype=np.uint8) for r in got if r["rep"] == rep])
        assert often.tolist() == np.bincount(whole(rep, 0, 100, 100, 7), minlength=100).tolist()


def test_mixed_numbers():
    values = [0, 1, 2**31 - 2, 2**31 - 1, 2**31, 2**32 - 1, 2**62 - 1, *range(10**9, 5 * 10**9, 10**7 + 1)]
    p = 2**31 - 1

    def mixed(v):
        once = (v % p * 48271 + 11) % p
        return (once * once + 12345) % p * 69621 % p
    assert bootstrap._mixed(np.array(values, dtype=np.int64)).tolist() == [mixed(v) for v in values]


def test_a_listing_row_is_read_once(spark):
    plan = plan_of(chunks.listing_rows(pages._listing(spark, FOLDER)))
    assert plan.count("fda-attachment-file-media\\s") + plan.count("fda-attachment-file-media(?:") <= 2  # looked for, then taken


def test_a_dataset_reads_its_cases_once(spark):
    plan = plan_of(derived.dataset(spark, FOLDER))
    assert "l_partkey" not in plan


def test_gold_and_excerpts_need_no_fusion(spark, monkeypatch):
    def fail(*args, **kwargs):
        raise AssertionError("worked out for nothing")
    monkeypatch.setattr(retrieval.FU, "hybrid_rules", fail)
    monkeypatch.setattr(retrieval.FU, "dense_rules", fail)
    assert retrieval.gold_in_book(spark, FOLDER).count() > 0
    assert retrieval.gold_by_part(spark, FOLDER).count() > 0
    assert retrieval.excerpt_texts(spark, FOLDER).count() > 0


def test_facts_of_one_split_are_many_tasks(spark):
    docs = spark.createDataFrame([(str(i), "FACTS AND VIOLATIVE CONDUCT He sold notes.") for i in range(64)], "case_no string, text string").coalesce(1)
    cases = docs.selectExpr("case_no", "'test' AS split")
    assert "Repartition" in plan_of(documents.facts_rows(cases, docs))


def test_word_ranks_need_no_row_per_score_and_candidate(spark):
    """Ranks of matched and unmatched candidates, and no list of a query's candidates beside each score."""
    chunks_of = {1: {0: 2.0, 3: 5.0, 4: 2.0, 9: 1.0}, 2: {}, 3: {5: 1.0}}
    rows = [(q, c, s) for q, own in chunks_of.items() for c, s in own.items()]
    scores = spark.createDataFrame(rows, "q int, chunk_id long, score double")
    wanted = spark.createDataFrame([(q, c) for q in chunks_of for c in (0, 1, 4, 5, 8, 11)], "q int, chunk_id long")
    ranks = fusion._bm25_ranks(scores, wanted, "q")
    assert "filter(" not in plan_of(ranks)
    for r in ranks.collect():
        own = chunks_of[r.q]
        order = sorted(range(12), key=lambda c: (-own.get(c, 0.0), c))
        assert r["rank"] == order.index(r.chunk_id) + 1
    assert ranks.count() == 18


def test_sentences_are_worked_out_once(spark):
    # one for violations, and one for a reader
    assert plan_of(text.document_sentences(spark, FOLDER)).count("in contravention of") == 2
    assert plan_of(text.label_evidence(spark, FOLDER)).count("in contravention of") == 1


def test_a_page_body_is_read_once(spark):
    """Not once more for the filter on its words (F26)."""
    plan = plan_of(chunks.page_chunks(retrieval._rule_pages(spark, FOLDER)))
    assert plan.count("Redesignated") == 1


def test_weights_without_numbers(spark):
    """The same weights in one job: terms are neither sorted into ranges nor written (F17)."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    own = classifier.own_weights(docs, "doc_id", "text")
    got = {(r.doc_id, r.term): round(r.weight, 9) for r in own.collect()}
    fitted = classifier.fit_tfidf(docs, "doc_id", "text").weights(docs, "doc_id", "text")
    assert got == {(r.doc_id, r.term): round(r.weight, 9) for r in fitted.collect()}
    assert "casemill-rows" not in str(own.inputFiles())


def test_citation_patterns_look_for_a_letter_first():
    """A word boundary costs more at every character (F16)."""
    assert all(p.head.startswith(("(?=", patterns.NASD_NAME)) for p in patterns.CITATION_PATTERNS)


def test_orders_are_dealt_over_tasks(spark):
    """Texts are worked on where an order's items are collected: neither a small shuffle nor a scan of one row group makes that one task."""
    items = derived.table(spark, FOLDER, "lineitem")
    rows = derived.ordered_lines(spark, FOLDER)
    assert rows.rdd.getNumPartitions() >= tasks(items) >= 4 * spark.sparkContext.defaultParallelism
    dealt = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(dealt) == items.select("l_orderkey").distinct().count() and max(dealt) < 3 * sum(dealt) / tasks(items)


def test_regression_keeps_numbers_per_row_not_per_term(spark, monkeypatch):
    """Terms numbered up to a thousand million: as many coefficients would not fit the driver. Scores are as with few."""
    rows = [(i, ([i % 2, 2 + i % 3], [0.8, 0.6]), i % 2) for i in range(12)]
    schema = "doc_id long, features struct<index: array<int>, weight: array<double>>, a int"
    few = spark.createDataFrame(rows, schema)
    far = few.selectExpr("doc_id", "named_struct('index', transform(features.index, x -> x * 200000000), 'weight', features.weight) AS features", "a")
    sizes, whole = [], regression._pass
    monkeypatch.setattr(regression, "_pass", lambda cells, parts, *x: sizes.append(parts.shape[1]) or whole(cells, parts, *x))
    models = classifier.fit_labels(far, ["a"], 10**9)
    assert set(sizes) == {12}
    got = {r.doc_id: r.p for r in classifier.predict_labels(models, far, "doc_id", "m").collect()}
    plain = classifier.predict_labels(classifier.fit_labels(few, ["a"], 5), few, "doc_id", "m")
    want = {r.doc_id: r.p for r in plain.collect()}
    assert len(want) == 12 and all((want[i] > 0.5) == (i % 2 == 1) and abs(got[i] - want[i]) < 1e-4 for i in want)


def test_weights_shuffle_no_row_per_document_and_term(spark, monkeypatch):
    """Blocks and buckets of a few characters give the weights of the plain way; ids may be null or repeated, texts too."""
    texts = ["sold notes to the firm", "the firm sold notes notes", "Notes of the ÉTAT firm 2024", "a b", "", None, "only once here", "the notes", "The NOTES"] * 3
    docs = spark.createDataFrame([(None if i % 9 == 7 else i % 20, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(classifier, "BLOCK", 40)
    found = classifier.own_weights(docs, "doc_id", "text", min_df=2, max_df=0.8)
    assert "hashpartitioning(term" not in found._jdf.queryExecution().toString()
    fitted = classifier.fit_tfidf(docs, "doc_id", "text", min_df=2, max_df=0.8).weights(docs, "doc_id", "text")

    def rows(df):
        return sorted((-1 if r.doc_id is None else r.doc_id, r.term, round(r.weight, 9)) for r in df.collect())
    assert rows(found) == rows(fitted) and len(rows(found)) > 100
    assert classifier.own_weights(docs.limit(0), "doc_id", "text").count() == 0
