"""The jobs end to end on a small workspace."""

import datetime

from casemill.plans import stages
from casemill.plans.stages import Tables

LEAD = "Firms Fined\n{who} (CRD #{n}, Reno, Nevada)\nMay 4, {year} – An AWC was issued. {what} (FINRA Case #20{year}00000{n:03d})\n"


def _texts():
    for n in range(60):
        year = 2018 if n < 40 else 2023
        what = ("It failed to supervise the branch office staff." if n % 2 else "It made unsuitable sales of leveraged funds to clients.")
        rule = "3110" if n % 2 else "2111"
        yield n, year, what, rule


def test_from_reports_to_scores(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    reports, docs = [], []
    for n, year, what, rule in _texts():
        reports.append((f"https://x/files/actions-may-{year}-{n}.pdf", "May %d\n" % year + LEAD.format(who=f"Firm {n}", n=n, year=year, what=what)))
        filler = "The client lost money in the account over the year. " * 8
        docs.append((f"20{year}00000{n:03d}", f"d{n}", datetime.date(year, 5, 4),
                     f"FACTS AND VIOLATIVE CONDUCT {what} {filler} The firm violated FINRA Rules {rule} and 2010. WAIVER OF PROCEDURAL RIGHTS x."
                     if n else "An unreadable scan."))
    spark.createDataFrame(reports, "report_url string, text string").write.parquet(t.path("raw.reports"))
    spark.createDataFrame(docs, "case_no string, doc_url string, action_date date, text string").write.parquet(t.path("raw.documents"))
    spark.createDataFrame([(docs[0][0], "d0", datetime.date(2018, 5, 4), "It violated FINRA Rule 2111.")],
                          "case_no string, doc_url string, action_date date, text string").write.parquet(t.path("raw.scans"))
    assert stages.parse_reports(t).count() == 60
    found = stages.label_documents(t)
    assert found.filter("doc_rules <> ''").count() == 59 and found.filter("n_docs = 1").count() == 60
    assert [r.ocr_rules for r in stages.label_scans(t).collect()] == ["FINRA:2111"]
    data = stages.build_dataset(t, 5)
    assert {(r.split, r["count"]) for r in data.groupBy("split").count().collect()} == {("train", 40), ("validation", 20)}
    assert data.filter("label_source = 'ocr'").count() == 1
    facts, funnel = stages.extract_facts(t)
    assert facts.count() == 59 and {r.reason: r.cases for r in funnel.collect()} == {"kept": 59, "no facts heading": 1}
    assert facts.filter("facts_text like '%violat%' or facts_text like '%3110%'").count() == 0
    assert stages.train_baseline(t).count() == 40
    scores = stages.score_predictions(t, 20)
    assert {r.f1 for r in scores["classes"].collect()} == {1.0}
    assert scores["intervals"].first().value == 1.0
    book = [(0, "2111", "2111. Suitability", "u", "2111. Suitability Recommendations of funds to clients must not be unsuitable for the clients at all."),
            (1, "3110", "3110. Supervision", "u", "3110. Supervision Each member shall supervise its branch office staff with written procedures daily.")]
    spark.createDataFrame(book, "page_order int, rule_no string, title string, url string, text string").write.parquet(t.path("raw.rulebook_pages"))
    assert stages.index_rulebook(t).count() == 2
    rates = stages.evaluate_search(t).first()
    assert (rates.cases, rates.hit_rate, rates.mrr) == (20, 1.0, 1.0)
    by_rule = {"2111": [1.0, 0.0], "3110": [0.0, 1.0]}
    spark.createDataFrame([(r.chunk_id, by_rule[r.rule_no]) for r in t.read("chunks").collect()], "chunk_id long, embedding array<float>").write.parquet(t.path("raw.chunk_vectors"))
    spark.createDataFrame([(r.case_no, by_rule["3110" if "3110" in r.rules else "2111"]) for r in data.collect()],
                          "case_no string, embedding array<float>").write.parquet(t.path("raw.query_vectors"))
    rates = {r.retriever: (r.cases, r.hit_rate, r.mrr) for r in stages.evaluate_retrievers(t).collect()}
    assert rates == {name: (20, 1.0, 1.0) for name in ("bm25", "dense", "hybrid")}
    base = t.read("model.predictions")
    n_series = base.select("series").distinct().count()
    wrong = base.selectExpr("case_no", "'other' AS model", "series", "y", "1 - p AS p")
    third = base.selectExpr("case_no", "'third' AS model", "series", "y", "p")
    t.replace(base.unionByName(wrong).unionByName(third), "model.predictions")
    scored = stages.score_test(t, ["baseline", "other", "third"], 20)
    assert {r.name: r.value for r in scored["intervals"].collect()}["baseline minus other"] == 1.0
    assert sorted(r.verdict for r in scored["verdicts"].collect()) == ["Failed", "Met"]
    assert scored["wide"].count() == 20 and len(scored["wide"].columns) == 1 + 3 * n_series
    both = {r.name: r.value for r in stages.compare_inputs(t, "baseline", "other", 10, reps=5).collect()}
    assert both["other minus baseline"] == -1.0
