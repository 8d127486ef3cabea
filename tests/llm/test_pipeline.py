"""The pipeline, stage by stage, against brute force on each stage's own input; registered queries against their SQL."""

import pyarrow as pa
import pytest
from oracle import compare, connect

import corpus_pipeline
from casemill.llm import quality
from casemill.llm.queries import QUERIES, op8_quality
from test_quality import measured
from test_resemblance import brute_kept

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_duplicates", "packed_sequences"]
    (_, classify), (_, rules), (_, near), (_, pack) = corpus_pipeline.STAGES
    first = classify(spark, docs, FOLDER)
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in op8_quality(spark, FOLDER).filter("predicted = 1").collect()}
    second = rules(spark, docs, FOLDER)
    kept = {r.doc_id for r in second.collect()}
    for i, r in rows.items():
        n, chars, symbols, dup, repeat = measured(r.text)
        if n < 50 or 100 * repeat > 50 * n or 100 * symbols > 10 * n:
            assert i not in kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(i in kept for i, q in labels.items() if q == 1 and measured(rows[i].text)[0] >= 50)
    third = near(spark, docs, FOLDER)
    assert third.columns == docs.columns
    stay = set(brute_kept([(i, r.text) for i, r in rows.items()]))
    assert sorted(tuple(r) for r in third.collect()) == sorted(tuple(r) for i, r in rows.items() if i in stay)
    packed = pack(spark, docs, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(rows)
    assert all(sum(r.length for r in packed if r.doc_id == i) == next(r.doc_tokens for r in packed if r.doc_id == i) for i in list(rows)[:20])


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", "1 AS score", "2 AS failed", "3 AS fp", "4 AS row", "5 AS label")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    """Of short texts at most 500 rows at once, of long ones some 4 MB, in each stage."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "mb": [b.nbytes / 1e6]})

    names = list(corpus_pipeline.BATCH)
    for _, stage in corpus_pipeline.STAGES:
        for name in names:
            spark.conf.unset(name)
        stage(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").limit(3), FOLDER)
        short = spark.range(0, 3000, 1, 1).selectExpr("'a b c' AS text").mapInArrow(sizes, "rows long, mb double").collect()
        assert max(r.rows for r in short) == 500 and sum(r.rows for r in short) == 3000
        long = spark.range(0, 400, 1, 1).selectExpr("repeat('word ', 20000) AS text").mapInArrow(sizes, "rows long, mb double").collect()
        assert max(r.mb for r in long) < 6 and sum(r.rows for r in long) == 400


def test_run(spark):
    whole = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in docs.collect()}
    assert quality.V1.mask == 2 ** len(quality.RULES) - 1


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, *QUERIES[name]) is None
