"""Scores over long prediction tables (case_no, model, series, y, p) and label sets.

Empty denominators give null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.functions.arrays import key_set


def predicted(p: Column, threshold: float = C.THRESHOLD) -> Column:
    return (p >= threshold).cast("int")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def class_scores(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Support, predictions, F1 and Brier score per class."""
    y, hit = F.col("y"), predicted(F.col("p"))
    counts = predictions.groupBy(*by, "series").agg(
        F.sum(y).alias("support"), F.sum(hit).alias("predicted"), F.sum(y * hit).alias("tp"),
        F.avg(F.pow(y - F.col("p"), 2)).alias("brier"))
    return counts.select(*by, "series", "support", "predicted", f1(
        F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")).alias("f1"), "brier")


def macro_f1(scores: DataFrame, by: Sequence[str] = ("model",), min_support: int = C.MIN_SUPPORT) -> DataFrame:
    """Mean F1 over all classes, over classes with enough support, and how many those are."""
    enough = F.col("support") >= min_support
    return scores.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"), F.avg(F.when(enough, F.col("f1"))).alias("macro_f1_supported"),
        F.count_if(enough).alias("supported_classes"), F.count("*").alias("classes"))


def ensemble(predictions: DataFrame, members: Sequence[str], name: str = "average") -> DataFrame:
    """Mean probability of the members per (case, class)."""
    return (predictions.filter(F.col("model").isin(*members)).groupBy("case_no", "series")
            .agg(F.max("y").alias("y"), F.avg("p").alias("p")).withColumn("model", F.lit(name)))


def class_set_mismatches(predictions: DataFrame, members: Sequence[str]) -> DataFrame:
    """Classes that not every member predicts; empty when the members can be averaged."""
    return (predictions.filter(F.col("model").isin(*members)).groupBy("series")
            .agg(F.count_distinct("model").alias("members")).filter(F.col("members") < len(members)))


def best_configuration(scores: DataFrame, config: str, score: str) -> DataFrame:
    """The configuration with the highest score; the first by name among equals."""
    return scores.agg(F.min_by(F.struct(config, score), F.struct(-F.col(score), F.col(config))).alias("best")).select("best.*")


def verdicts(results: DataFrame, expectations: dict[str, float] = C.EXPECTATIONS) -> DataFrame:
    """Met or Failed for each (name, value) with an expectation."""
    limits = F.create_map(*[F.lit(x) for pair in expectations.items() for x in (pair[0], float(pair[1]))])
    limit = F.try_element_at(limits, F.col("name"))
    return results.withColumn("expected", limit).filter(F.col("expected").isNotNull()).withColumn(
        "verdict", F.when(F.col("value") >= F.col("expected"), "Met").otherwise("Failed"))


def reliability(predictions: DataFrame, bins: int = 10, by: Sequence[str] = ("model",)) -> DataFrame:
    """Points, mean prediction and observed share per probability bin; p = 1 falls in the last bin."""
    at = F.least((F.col("p") * bins).cast("int"), F.lit(bins - 1))
    return predictions.groupBy(*by, at.alias("bin")).agg(
        F.count("*").alias("points"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed"))


def expected_calibration_error(table: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    gap = F.col("points") * F.abs(F.col("mean_predicted") - F.col("observed"))
    return table.groupBy(*by).agg((F.sum(gap) / F.sum("points")).alias("ece"))


def set_precision_recall(df: DataFrame, found: str, true: str, gate: float = C.LABEL_GATE) -> DataFrame:
    """Micro precision and recall of one label set against another, and whether both reach the gate."""
    p, t = key_set(F.col(found)), key_set(F.col(true))
    sums = df.select(F.size(F.array_intersect(p, t)).alias("tp"), F.size(F.array_except(p, t)).alias("fp"),
                     F.size(F.array_except(t, p)).alias("fn")).agg(
        F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("rows", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
                       F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall")).withColumn(
        "verdict", F.when((F.col("precision") >= gate) & (F.col("recall") >= gate), "PASS").otherwise("FAIL"))


def hand_check_scores(check: DataFrame) -> DataFrame:
    """Precision and recall of the checked rows of a hand-check table."""
    return set_precision_recall(check.filter(F.upper(F.trim("checked")) == "Y"), "doc_rules", "true_rules")


def set_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with both label sets, the share with equal sets, and the mean Jaccard similarity."""
    x, y = key_set(F.col(a)), key_set(F.col(b))
    both = df.select(x.alias("x"), y.alias("y")).filter((F.size("x") > 0) & (F.size("y") > 0))
    common, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return both.agg(F.count("*").alias("both"), F.avg((common == union).cast("int")).alias("identical"),
                    F.avg(common / union).alias("jaccard"))


def catch_all_share(df: DataFrame, rules: str) -> DataFrame:
    """Share of labelled rows that hold the catch-all rule."""
    keys = key_set(F.col(rules))
    return df.select(keys.alias("k")).filter(F.size("k") > 0).agg(
        F.count("*").alias("labelled"), F.avg(F.array_contains("k", C.CATCH_ALL_RULE).cast("int")).alias("share"))


def value_shares(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of each value and its share of all rows."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and the given column values, zeros filled, with a total over those values."""
    table = df.groupBy(row).pivot(column, list(values)).count().fillna(0, list(values))
    return table.withColumn("total", sum((F.col(v) for v in values[1:]), F.col(values[0])))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two raters."""
    counts = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    # one row per pair of labels from here on
    by_a = counts.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    by_b = counts.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = by_a.join(by_b, "label").agg(F.sum(F.col("na") * F.col("nb"))).scalar()
    observed = counts.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))),
                                                            F.lit(0)).alias("agree"))
    agreement, expected = F.col("agree") / F.col("n"), F.coalesce(chance, F.lit(0)) / (F.col("n") * F.col("n"))
    return observed.select("n", agreement.alias("agreement"),
                           F.try_divide(agreement - expected, 1 - expected).alias("kappa"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """How far probabilities moved between two answers to the same (case, class)."""
    both = old.select("case_no", "series", F.col("p").alias("p0")).join(
        new.select("case_no", "series", F.col("p").alias("p1")), ["case_no", "series"])
    moved = F.abs(F.col("p1") - F.col("p0"))
    return both.agg(F.count("*").alias("pairs"), F.avg(moved).alias("mean_change"), F.max(moved).alias("max_change"),
                    F.sum((predicted(F.col("p0")) != predicted(F.col("p1"))).cast("int")).alias("flips"))


def _months(spark, start: str, end: str, month: str) -> DataFrame:
    first, last = F.to_date(F.lit(start + "-01")), F.to_date(F.lit(end + "-01"))
    days = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("d"))
    return days.select(F.date_format("d", "yyyy-MM").alias(month))


def gaps_by_month(found: DataFrame, start: str, end: str, month: str = "month") -> DataFrame:
    """Months from start to end (YYYY-MM) that have no row."""
    return _months(found.sparkSession, start, end, month).join(found.select(month).distinct(), month, "left_anti")


def month_coverage(found: DataFrame, start: str, end: str, is_pdf: Column, month: str = "month") -> DataFrame:
    """How many months there are from start to end, how many have a source, and how many of those a PDF or only a page."""
    best = found.groupBy(month).agg(F.bool_or(is_pdf).alias("_pdf"))
    return _months(found.sparkSession, start, end, month).join(best, month, "left").agg(
        F.count("*").alias("expected"), F.count("_pdf").alias("found"), F.count_if(F.col("_pdf")).alias("pdf"), F.count_if(~F.col("_pdf")).alias("page"))

