"""Stored answers and judgments: keeping cited rules, reports, hand labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.functions import rules as R
from casemill.functions.arrays import joined, split_keys
from casemill.operators.metrics import cohen_kappa
from casemill.sources.files import parse_cited

RUN_KEY = ("kind", "item_id", "model", "prompt")
JUDGMENT_KEY = ("item_id", "split", "model", "prompt", "answer_prompt")
HAND_VALUES = ("correct", "incorrect")
_CATCH_ALL_NUMBER = C.CATCH_ALL_RULE.split(":")[1]


def keep_cited(reasons: Column, shown: Column, declined: Column) -> Column:
    """``struct<decline, rules, outside>``: cited rules among the shown ones, in order and once; others counted.

    An answer with no rule left counts as declined.
    """
    bases = F.transform(shown, R.base_rule)
    cited = F.filter(F.transform(parse_cited(reasons), lambda c: R.rule_number_in(c["rule"])), lambda n: n != "")
    kept = F.array_distinct(F.filter(cited, lambda n: F.array_contains(bases, R.base_rule(n))))
    outside = F.size(F.filter(cited, lambda n: ~F.array_contains(bases, R.base_rule(n))))
    decline = F.coalesce(declined, F.lit(False)) | (F.size(kept) == 0)
    return F.struct(decline.alias("decline"), F.when(decline, "").otherwise(joined(kept)).alias("rules"),
                    outside.alias("outside"))


def answered(raw: DataFrame) -> DataFrame:
    """Raw model output (reasons JSON, decline flag) as rows of the answers table."""
    kept = keep_cited(F.col("reasons"), split_keys(F.col("chunk_rules")), F.col("decline"))
    return raw.withColumn("_k", kept).withColumn("decline", F.col("_k.decline")).withColumn(
        "rules", F.col("_k.rules")).withColumn("outside", F.col("_k.outside")).drop("_k")


def judged(answers: DataFrame, judgments: DataFrame, judge_prompt: str) -> DataFrame:
    """Answers with the judge's label for the same item, split, model and answer prompt."""
    labels = judgments.filter(F.col("prompt") == judge_prompt).select(
        "item_id", "split", "model", F.col("answer_prompt").alias("prompt"), F.col("label").alias("judge"))
    return answers.join(labels, ["item_id", "split", "model", "prompt"], "left")


def to_judge(answers: DataFrame, judgments: DataFrame, model: str, prompt: str) -> DataFrame:
    """Case answers the judge has not labelled under this model and prompt."""
    done = judgments.filter((F.col("model") == model) & (F.col("prompt") == prompt)).select(
        "item_id", "split", F.col("answer_prompt").alias("prompt"))
    return answers.filter("kind = 'case'").join(done, ["item_id", "split", "prompt"], "left_anti")


def with_gold(answers: DataFrame, dataset: DataFrame) -> DataFrame:
    """Answers to cases charged with a Rulebook rule, with cited and gold rules as arrays."""
    gold = dataset.select(F.col("case_no").alias("item_id"), R.rulebook_rules_of(F.col("rules")).alias("gold")).filter(F.size("gold") > 0)
    cited = F.filter(F.array_distinct(F.transform(split_keys(F.col("rules")), R.base_rule)), lambda r: r != _CATCH_ALL_NUMBER)
    shown = F.transform(split_keys(F.col("chunk_rules")), R.base_rule)
    return (answers.withColumn("cited", cited).join(gold, "item_id")
            .withColumn("hits", F.size(F.array_intersect("cited", "gold")))
            .withColumn("retrieved", F.arrays_overlap(shown, F.col("gold"))))


def answer_report(rows: DataFrame) -> DataFrame:
    """One row of shares over answers with gold (see ``with_gold``) and a judge column."""
    as_int = lambda c: F.col(c).cast("int")
    return rows.agg(
        F.count("*").alias("cases"), F.avg(as_int("decline")).alias("declined"),
        F.avg(as_int("retrieved")).alias("charged_rule_retrieved"),
        F.avg((F.col("hits") > 0).cast("int")).alias("charged_rule_cited"),
        F.coalesce(F.try_divide(F.sum("hits"), F.sum(F.size("cited"))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.sum("hits"), F.sum(F.size("gold"))), F.lit(0.0)).alias("recall"),
        F.sum("outside").alias("outside"),
        F.avg(F.coalesce(F.col("judge") == "correct", F.lit(False)).cast("int")).alias("judge_correct"),
        F.count("judge").alias("judged"),
        F.count_if(F.col("decline") & F.col("retrieved")).alias("declined_with_rule_shown"),
        F.count_if(~F.col("decline") & (F.col("hits") == 0)).alias("no_charged_rule_cited"))


def declined_with_rule_shown(rows: DataFrame, n: int = 8) -> DataFrame:
    """The first n declines although a charged rule was among the excerpts."""
    return rows.filter(F.col("decline") & F.col("retrieved")).select("item_id", joined(F.col("gold")).alias("gold"), "chunk_rules").orderBy("item_id").limit(n)


def without_charged_rule(rows: DataFrame, n: int = 8) -> DataFrame:
    """The first n answers that cite no charged rule."""
    return rows.filter(~F.col("decline") & (F.col("hits") == 0)).select(
        "item_id", joined(F.col("gold")).alias("gold"), joined(F.col("cited")).alias("cited")).orderBy("item_id").limit(n)


def decline_counts(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Kept questions and how many of their answers declined."""
    return kept_answers(questions, answers).agg(F.count("*").alias("questions"), F.sum(F.col("decline").cast("int")).alias("declined"))


def kept_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    kept = questions.filter(F.upper(F.trim("keep")) == "Y").drop("question")
    return kept.join(answers, kept["id"] == answers["item_id"])


def answered_questions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Kept out-of-scope questions that were answered instead of declined."""
    return kept_answers(questions, answers).filter(~F.col("decline")).select("id", "question", "governing_source", "rules", "chunk_rules")


def invalid_labels(df: DataFrame, label: str = "label", allowed: Sequence[str] = HAND_VALUES) -> DataFrame:
    return df.filter(~F.coalesce(F.lower(F.trim(label)), F.lit("")).isin(*allowed))


def require_labels(df: DataFrame, key: str, label: str = "label", allowed: Sequence[str] = HAND_VALUES) -> None:
    """Raise when a row's label is not allowed, naming ten of them."""
    bad = [r[0] for r in invalid_labels(df, label, allowed).orderBy(key).limit(10).select(key).collect()]
    if bad:
        raise ValueError(f"no label of {' or '.join(allowed)}: {bad}")


def hand_label_sheet(rows: DataFrame) -> DataFrame:
    """Answers to label by hand, without the judge's label."""
    listed = F.transform(parse_cited(F.col("reasons")), lambda c: F.concat(c["rule"], F.lit(": "), c["reason"]))
    return rows.select(F.col("item_id").alias("case_no"), F.array_join("gold", ", ").alias("finra_charged"),
                       F.col("decline").alias("declined"),
                       F.when(F.col("decline"), "").otherwise(F.array_join(listed, " | ")).alias("answer_rules"),
                       F.lit("").alias("label"), F.lit("").alias("notes"))


def judge_kappa(hand: DataFrame, judged_answers: DataFrame) -> DataFrame:
    """Agreement of hand labels and judge over the same cases."""
    both = hand.select("case_no", F.lower(F.trim("label")).alias("hand")).join(
        judged_answers.select(F.col("item_id").alias("case_no"), "judge"), "case_no")
    return cohen_kappa(both, "hand", "judge")


def ask_again(old_runs: DataFrame, n: int) -> DataFrame:
    """The first n answered cases, for a drift check."""
    return old_runs.orderBy("case_no").limit(n)

