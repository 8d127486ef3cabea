"""Case documents and monthly reports on our own strings."""

import datetime
import random

from pyspark.sql import functions as F

from casemill.functions import citations as C
from casemill.functions import documents as D
from casemill.functions import reports as R
from casemill.operators import documents as O


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t"))).first()[0]


def test_sentences(spark):
    text = "It paid $2.5 million. It violated the act. No end but 3.5"
    assert one(spark, text, D.sentences) == ["It paid $2.5 million.", " It violated the act.", " No end but 3."]
    assert one(spark, "x" * 30000, D.sentences) == []
    assert one(spark, "", D.sentences) == []
    # a violation after the tail's last period does not count
    assert one(spark, "a fee of 3.5 was a violation", D.violation_sentences) == []
    assert one(spark, "a violation cost 3.5 in all", D.violation_sentences) == ["a violation cost 3."]


def test_document_labels(spark):
    text = ("Under FINRA Rule 9216 it settles the alleged rule violations. FINRA Rule 4530 requires reports.\n"
            "The firm, fined $1.5 million, violated FINRA Rules 45 l l and 2010. In 2012 the firm was fined for violations of "
            "FINRA Rule 5310 in that proceeding. She waives claims of a violation of FINRA Rule 8313. "
            "The desk violated Exchange Act Section 19 and NASD Rule 3010. "
            "II. Waiver of  Procedural Rights It violated FINRA Rule 1122.")
    assert one(spark, text, D.document_labels) == ["FINRA:4511", "FINRA:2010", "NASD:3010"]


def test_review_sentences_cut_before_inner_periods(spark):
    text = "It paid $2.5 million for a violation. Nothing here. See FINRA Rule 3110"
    assert one(spark, text, D.review_sentences) == ["5 million for a violation.", "See FINRA Rule 3110"]


def test_facts_section(spark):
    text = ("OVERVIEW He violated FINRA Rule 3270. FACTS AND VIOLATIVE CONDUCT Late filing (Violation of FINRA Rule 1122) "
            "From 2019 he ran a bakery. He told nobody. By this he violated FINRA Rule 3270. He earned $9,000. "
            "B. They also consent to the imposition of the following sanctions: repayment. After that.")
    row = one(spark, text, D.facts_section)
    assert row.start == "facts and violative conduct"
    assert row.facts == "Late filing   From 2019 he ran a bakery. He told nobody. He earned $9,000."
    assert tuple(one(spark, "No heading at all. It violated the act.", D.facts_section)) == ("", "")
    # the end is looked for after the heading's own words
    short = one(spark, "Findings of Fact and CONCLUSIONS OF LAW The desk sold notes to clients. It kept no log.", D.facts_section)
    assert short.start == "findings of fact" and short.facts.endswith("It kept no log.")


def test_narrative(spark):
    text = ("A client complained. FINRA Rule 3260 prohibits trading without consent.On May 1 he traded. Regulatory Notice 9 reminds firms. "
            "FINRA asked under Rule 8210 for papers. Selling away violates FINRA Rule 3280.")
    assert one(spark, text, lambda t: D.narrative(C.mask_citations(t))) == \
        "A client complained. On May 1 he traded. FINRA asked under [RULE] for papers."


def test_query_text(spark):
    text = ("Acme was fined $5.  Acme consented to the entry of findings that it kept no log. It sold notes. The fine is in effect.")
    assert one(spark, text, D.query_text) == "it kept no log. It sold notes."
    assert one(spark, "A bar.", D.query_text) == "A bar."
    assert one(spark, None, D.query_text) == ""


def test_unlabeled_reason(spark):
    pad = "The record is long and dull. " * 20
    texts = {None: "not cached", "short": "no text", pad + "FINRA Rule 3110 exists.": "no violation", pad + "It violated duties.": "no citation",
             pad: "neither", pad + "FINRA Rule 3110 exists. It violated duties.": "apart"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.r for r in df.select("t", D.unlabeled_reason(F.col("t")).alias("r")).collect()} == texts


REPORT = """12
Disciplinary and Other FINRA Actions | March 2024 3
Actions
Firms Fined
Gamma Bank (CRD #9, Reno, Nevada)
March  4, 2024 – An AWC was issued. The firm's work-
shops failed FINRA Rule 3110. (FINRA Case #2021000000001)
Firm staff of Delta LLC (CRD #8, Troy, Ohio)
March 44, 2024 – The firm erred. (FINRA
Case #2021000000002)
Individuals Barred
Ann Ray (CRD #7)
She refused. (FINRA Case #2021000000003)
FINRA Case #2021000000004 has no parentheses
"""


def test_segment_report(spark):
    reports = spark.createDataFrame([("u", "2024-03", REPORT)], "report_url string, report_month string, text string")
    rows = sorted(O.segment_reports(reports).collect(), key=lambda r: r.pos)
    assert [r.case_no[-1] for r in rows] == ["1", "2", "3"]
    assert [r.section for r in rows] == ["Firms Fined", "Firms Fined", "Individuals Barred"]
    assert [r.respondent for r in rows] == ["Gamma Bank", "Firm staff of Delta LLC", "Ann Ray"]
    assert [r.action_date for r in rows] == [datetime.date(2024, 3, 4), None, None]
    assert rows[0].text.endswith("workshops failed FINRA Rule 3110.") and "Disciplinary" not in rows[0].text


def test_monthly_cases_keep_the_latest_report(spark):
    reports = spark.createDataFrame([("a", "2024-03", REPORT), ("b", "2024-04", REPORT.replace("Gamma", "Omega"))],
                                    "report_url string, report_month string, text string")
    rows = {r.case_no[-1]: r for r in O.monthly_cases(reports).collect()}
    assert len(rows) == 3 and rows["1"].respondent == "Omega Bank" and rows["1"].summary_rules == "FINRA:3110"
    assert "[RULE]" in rows["1"].masked_text and "3110" not in rows["1"].masked_text


def test_report_month(spark):
    urls = {"https://x/2024-07/actions-july-2024.pdf": "2024-07", "https://x/Actions_May%202023.pdf": "2023-05",
            "https://x/files/2025-01/Dec_Actions.pdf": "2024-12", "https://x/files/2024-11/11_Nov_Actions.pdf": "2024-11",
            "https://x/files/2025-01/Decisions.pdf": None, "https://x/Sept_2021_list.pdf": "2021-09"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.m for r in df.select("u", R.report_month(F.col("u"), F.lit("")).alias("m")).collect()} == urls
    assert df.limit(1).select(R.report_month(F.lit("https://x/p1.pdf"), F.lit("Actions\nJanuary 2011"))).first()[0] == "2011-01"


def test_leak_audit_and_titles(spark):
    rows = spark.createDataFrame([("1", "clean [RULE]"), ("2", "see Rule 31 and Rule 31 again")], "case_no string, masked_text string")
    got = O.leak_audit(rows, around=4).orderBy("nth").collect()
    assert [(r.case_no, r.leak, r.context) for r in got] == [("2", "Rule 3", "see Rule 31 an"), ("2", "Rule 3", "and Rule 31 ag")]
    titles = spark.createDataFrame([("Outside Business Activities",), ("Short",)], "title string")
    texts = spark.createDataFrame([(1, "his OUTSIDE business activities"), (2, "a short one")], "id int, t string")
    found = O.titles_in_text(texts.withColumn("l", F.lower("t")), titles.select(F.lower("title").alias("title")), "l", "title", ["id"])
    assert sorted((r.id, r.title) for r in found.collect()) == [(1, "outside business activities"), (2, "short")]
    assert [r.id for r in O.title_leaks(texts, titles, "t", "title", ["id"]).collect()] == [1]


def test_titles_by_anchor_equal_brute_force(spark):
    """Titles of one to five words, parts of words at both ends, blanks inside, the empty title, nulls and repeats."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    texts = [(i, rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(90, None), (91, "")]
    cuts = [t[a:a + rng.randint(0, 14)] for _, t in texts if t for a in (rng.randrange(len(t)),)]
    titles = cuts + [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(60)] + [None, "", "a a", "zz zz zz"]
    found = O.titles_in_text(spark.createDataFrame(texts, "id int, t string").repartition(3), spark.createDataFrame([(t,) for t in titles], "n string"),
                             "t", "n", ["id"])
    want = sorted((i, n) for i, t in texts if t is not None for n in {n for n in titles if n is not None} if n in t)
    assert sorted((r.id, r.n) for r in found.collect()) == want
    assert O.titles_in_text(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([], "n string"), "t", "n", ["id"]).count() == 0
