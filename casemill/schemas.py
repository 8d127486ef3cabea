"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "date": T.DateType(), "array<float>": T.ArrayType(T.FloatType())}


def _table(columns: str) -> T.StructType:
    """A schema from "name type, ..."; built without a session, so the module can be imported before one exists."""
    pairs = (c.split() for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


MONTHLY_CASES = _table("case_no string, report_url string, report_month string, section string, respondent string, "
                       "action_date date, text string, masked_text string, summary_rules string")
DOCUMENT_INDEX = _table("case_no string, doc_url string, doc_type string, respondent string, action_date date")
DOCUMENT_LABELS = _table("case_no string, doc_url string, doc_rules string, n_docs int, search_status int")
OCR_LABELS = _table("case_no string, doc_url string, ocr_rules string")
RULEBOOK_PAGES = _table("rule_no string, title string, url string, text string")
DATASET = _table("case_no string, year int, split string, masked_text string, rules string, label_source string, "
                 "labels string")
FACTS = _table("case_no string, split string, facts_text string, chars int, start string")
ZEROSHOT_RUNS = _table("case_no string, model string, prompt_version string, think boolean, probs string, "
                       "seconds double")
PREDICTIONS = _table("case_no string, model string, series string, y int, p double")
CHUNKS = _table("chunk_id bigint, rule_no string, title string, url string, part int, text string, "
                "embedding array<float>")
ANSWERS = _table("kind string, item_id string, split string, question string, chunk_rules string, decline boolean, "
                 "rules string, outside int, reasons string, answer string, model string, prompt string")
JUDGMENTS = _table("item_id string, split string, label string, reason string, model string, prompt string, "
                   "answer_prompt string")
QUESTIONS = _table("id string, question string, governing_source string, why_finra_rules_dont_answer string, "
                   "keep string")
HAND_LABELS = _table("case_no string, finra_charged string, declined string, answer_rules string, label string, "
                     "notes string")
HAND_CHECK = _table("case_no string, doc_url string, doc_rules string, true_rules string, checked string, notes string")

CITED = "array<struct<rule:string,reason:string>>"
PROBABILITIES = "map<string,double>"
