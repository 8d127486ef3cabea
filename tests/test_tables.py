"""Labels, dataset, stored tables, order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casemill import schemas
from casemill.functions import rules as R
from casemill.functions.arrays import split_keys
from casemill.operators import labels as L
from casemill.operators import ordering as O
from casemill.sources import files as S
from casemill.sources import tables as T


def test_rule_keys(spark):
    df = spark.createDataFrame([("NASD:3010|FINRA:9268|SEC_RULE:15c3-1|FINRA:0150|NASD:2110|SEC_SECTION:19|NASD:9911|FINRA:2010",)], "k string")
    row = df.select(R.label_series(split_keys(F.col("k"))).alias("s"), R.rulebook_rules_of(F.col("k")).alias("r")).first()
    assert row.s == ["FINRA:3000", "NASD:9000", "SEC_RULE"] and row.r == ["3110"]
    keys = ["FINRA:11870", "NASD:IM-2210-1", "MSRB:G-17", "FINRA:x"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", R.series_label(F.col("k")).alias("s"), R.citation_series(F.col("k")).alias("c")).collect()
    assert {r.k: r.s for r in got} == {"FINRA:11870": "FINRA:11000", "NASD:IM-2210-1": "NASD:2000", "MSRB:G-17": "MSRB", "FINRA:x": "FINRA"}
    assert {r.k: r.c for r in got}["MSRB:G-17"] is None
    row = spark.range(1).select(R.clean_title(F.lit(" IM-12. Big   Rule. ")), R.rule_number_in(F.lit("see im-2110-2(a)")), R.rulebook_part(F.lit("13802"))).first()
    assert row[0] == "big rule" and row[1] == "IM-2110-2" and row[2].startswith("arbitration")


CASES = "case_no string, action_date date, report_month string, masked_text string, summary_rules string, doc_rules string"


def _cases(spark):
    rows = [(f"a{i}", None, "2018-04", "t", "", "FINRA:3110|FINRA:2010") for i in range(6)]
    rows += [("v1", None, "2023-01", "t", "", "NASD:3010"), ("c1", None, "2019-06", "t", "", "MSRB:G-1"), ("c2", None, "2024-03", "t", "", "FINRA:2010"),
             ("c3", None, "2015-03", "t", "", "FINRA:3110"), ("c4", None, "2018-03", "t", "", ""), ("c5", None, "2017-03", "t", "FINRA:3110", ""),
             ("c6", None, "bad", "t", "", "FINRA:3110")]
    return spark.createDataFrame(rows, CASES)


def test_case_labels_and_dataset(spark):
    cases = _cases(spark)
    ocr = spark.createDataFrame([("c4", "u", "FINRA:4511"), ("c5", "u", "FINRA:4511")], schemas.OCR_LABELS)
    by = {r.case_no: r for r in L.case_labels(cases, cases).collect()}
    assert by["c4"].rules == "" and by["c4"].label_source is None and by["c5"].label_source == "summary"
    by = {r.case_no: r for r in L.case_labels(cases, cases, ocr).collect()}
    assert by["c4"].label_source == "ocr" and by["c5"].rules == "FINRA:3110"
    data = {r.case_no: r for r in L.build_dataset(cases, L.case_labels(cases, cases), 5).collect()}
    assert not {"c3", "c4", "c6"} & set(data)
    assert data["a1"].labels == "FINRA:3000" and data["c1"].labels == "other" and data["c2"].labels == "" and data["c2"].split == "test"
    assert data["v1"].labels == "FINRA:3000" and data["v1"].split == "validation"
    assert [r.case_no for r in L.cases_needing_ocr(cases, cases.withColumn("n_docs", F.lit(1))).collect()] == ["c4"]
    with pytest.raises(ValueError, match="c3"):
        L.require_complete(cases.filter("case_no = 'c3'"), cases.filter("case_no = 'c4'"), "case_no")


def test_stored_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = spark.createDataFrame([("1", "m", 0.5), ("1", "m", 0.6), ("2", "m", 0.7)], "case_no string, model string, p double")
    assert T.optional_table(spark, path, runs.schema).count() == 0
    for _ in range(2):
        T.append_runs(runs, path, ["case_no", "model"])
    assert spark.read.parquet(path).count() == 2
    runs.withColumn("prompt", F.lit("v2")).write.mode("append").parquet(path)
    assert {r.prompt for r in T.load_evolved(spark, path, "prompt", "v1").collect()} == {"v1", "v2"}
    T.replace_table(runs, str(tmp_path / "t"), ["model"])
    assert T.load_table(spark, str(tmp_path / "t"), F.col("model") == "m", ["case_no"]).count() == 3


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'say "hi",\nthere'), ("2", None)], "id string, text string")
    S.write_csv(rows, str(tmp_path / "c"))
    assert {r.id: r.text for r in S.read_csv_strings(spark, str(tmp_path / "c"), ["id", "text"]).collect()} == {"1": 'say "hi",\nthere', "2": ""}
    probs = spark.createDataFrame([("1", "a", 1.5), ("1", "b", -1.0)], "case_no string, series string, p double")
    back = S.json_to_probs(S.probs_to_json(probs, ["case_no"]), ["a", "b", "c"])
    assert {r.series: r.p for r in back.collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
    (tmp_path / "l.txt").write_text("# no\n\n x \ny\n")
    assert [r.key for r in S.read_line_list(spark, str(tmp_path / "l.txt")).collect()] == ["x", "y"]


def test_order(spark):
    rows = spark.createDataFrame([(k, i, i % 3 == 0) for k in "ab" for i in range(7)], "k string, i int, ok boolean")
    assert {r.k: r.i for r in O.keep_latest(rows, ["k"], ["i"]).collect()} == {"a": 6, "b": 6}
    assert {r.k: (r.i, r.n_docs) for r in O.first_with_result(rows, "k", F.col("i") > 2, F.col("i")).collect()} == {"a": (3, 7), "b": (3, 7)}
    assert {r.k: r.i for r in O.first_with_result(rows, "k", F.lit(False), F.col("i")).collect()} == {"a": 6, "b": 6}
    numbered = O.global_row_number(rows.repartition(5), [F.col("i").desc(), F.col("k").asc()]).collect()
    assert sorted((r.row_number, -r.i, r.k) for r in numbered) == [(n + 1, *x) for n, x in enumerate(sorted((-r.i, r.k) for r in numbered))]
    sample = O.seeded_sample(rows, 5, O.hash_order(F.concat("k", "i"), 1), "i").collect()
    again = O.seeded_sample(rows.repartition(3), 5, O.hash_order(F.concat("k", "i"), 1), "i").collect()
    assert len(sample) == 5 and sorted(sample) == sorted(again)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10, 100, 101])
def test_thirds_are_equal_frequency_bins(spark, n):
    rows = spark.createDataFrame([(i, i // 2) for i in range(n)], "id int, w int")
    got = pd.Series([r.third for r in O.length_thirds(rows, F.col("w"), "id").orderBy("id").collect()])
    names = ["short", "medium", "long"][:min(3, n)]
    want = pd.qcut(pd.Series(np.arange(1, n + 1)), min(3, n), labels=names) if n > 1 else pd.Series(["short"])
    assert got.tolist() == want.astype(str).tolist()


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart, as they would on a large table."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_values_are_carried_over_range_borders(spark, many_ranges):
    # key a holds most rows and is cut into several ranges, some of them without any value; a null key is a key
    rng = np.random.default_rng(5)
    rows = [("a", i, f"v{i}" if rng.random() < 0.02 else None) for i in range(400)]
    rows += [(k, i, "w" if i == 1 else None) for k in (None, "b", "c") for i in range(4)] + [("0", 0, None)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k string, i int, v string").repartition(7)
    want, seen = {}, {}
    for k, i, v in rows:
        seen[k] = seen.get(k) if v is None else v
        want[k, i] = seen[k]
    got = O.carry_forward(df, ["k"], ["i"], "v", "out")
    assert got.columns == ["k", "i", "v", "out"] and {(r.k, r.i): r.out for r in got.collect()} == want
    parts = O._ranges(df, [F.col("k"), F.col("i")]).filter("k = 'a'").select("_part").distinct().count()
    assert parts > 3
    assert O.carry_forward(df.limit(0), ["k"], ["i"], "v", "out").count() == 0


def test_quantiles_by_selection(spark, many_ranges):
    rng = np.random.default_rng(6)
    groups = {"hot": rng.integers(0, 900, 3000) / 4, "one": np.array([7.0]), "two": np.array([1.0, 2.0]), None: rng.normal(size=50), "same": np.full(40, 3.0)}
    rows = [(g, float(x)) for g, values in groups.items() for x in values] + [("hot", None), ("empty", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    got = {r.g: r for r in O.quantiles(df, "x", at, ["g"]).collect()}
    assert got.keys() == {*groups, "empty"} and tuple(got["empty"]) == ("empty", 0, *[None] * 6)
    for g, values in groups.items():
        assert got[g].n == len(values) and list(got[g][2:]) == pytest.approx(np.quantile(values, at).tolist())
    whole = O.quantiles(df, "x", [0.5]).first()
    assert whole.n == len(rows) - 3 and whole.q50 == pytest.approx(np.median([x for _, x in rows if x is not None]))
