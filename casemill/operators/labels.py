"""Labels and the labelled dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.functions import rules as R
from casemill.functions.arrays import joined, key_set, split_keys
from casemill.sources.session import written


def split_for(year: Column, train: Sequence[int] = C.TRAIN_YEARS, validation: Sequence[int] = C.VALIDATION_YEARS,
              test: Sequence[int] = C.TEST_YEARS) -> Column:
    """train / validation / test by year, null outside."""
    return (F.when(year.between(*train), "train").when(year.between(*validation), "validation")
            .when(year.between(*test), "test"))


def case_year(action_date: Column, report_month: Column) -> Column:
    """The action's year, else the report month's, else null."""
    return F.coalesce(F.year(action_date), F.substring(report_month, 1, 4).try_cast("int"))


def case_labels(cases: DataFrame, documents: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """One row per case: its rules from the document, else the summary, else OCR, and which of them it was."""
    rows = cases.select("case_no", "summary_rules").join(documents.select("case_no", "doc_rules"), "case_no", "left")
    sources = [("document", "doc_rules"), ("summary", "summary_rules")]
    if ocr is not None:
        rows = rows.join(ocr.select("case_no", "ocr_rules"), "case_no", "left")
        sources.append(("ocr", "ocr_rules"))
    rules, origin = None, None
    for name, column in sources:
        some = F.coalesce(F.col(column), F.lit("")) != ""
        rules = F.when(some, F.col(column)) if rules is None else rules.when(some, F.col(column))
        origin = F.when(some, name) if origin is None else origin.when(some, name)
    return rows.select("case_no", rules.otherwise("").alias("rules"), origin.alias("label_source"))


def cases_needing_ocr(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Cases with a document but no rule from it or from the summary."""
    unlabeled = case_labels(cases, documents).filter("rules = ''").select("case_no")
    return unlabeled.join(documents.filter("n_docs > 0").select("case_no"), "case_no", "left_semi")


def merge_rare(df: DataFrame, series: str, min_cases: int = C.MIN_SERIES_CASES, out: str = "labels") -> DataFrame:
    """Replace series with fewer than ``min_cases`` training cases by ``other``; sorted, joined, possibly empty.

    The kept series come in as one small array (a scalar subquery), so no row is exploded and re-collected.
    """
    counts = (df.filter("split = 'train'").select(F.explode(series).alias("label")).groupBy("label").count()
              .filter(F.col("count") >= min_cases))
    keep = counts.agg(F.collect_set("label")).scalar()
    own = F.col(series)
    other = F.when(F.size(F.array_except(own, keep)) > 0, F.array(F.lit(C.OTHER_LABEL))).otherwise(F.array().cast("array<string>"))
    return df.withColumn(out, joined(F.sort_array(F.concat(F.array_intersect(own, keep), other))))


def build_dataset(cases: DataFrame, labels: DataFrame, min_cases: int = C.MIN_SERIES_CASES, **years) -> DataFrame:
    """Labelled cases with their split. Cases without any rule, or outside every split, are left out;
    a case that cites only the catch-all keeps an empty label set."""
    rows = (cases.select("case_no", "action_date", "report_month", "masked_text")
            .join(labels.filter("rules <> ''"), "case_no")
            .withColumn("year", case_year(F.col("action_date"), F.col("report_month")))
            .withColumn("split", split_for(F.col("year"), **years)).filter("split is not null")
            .withColumn("series", R.label_series(split_keys(F.col("rules")))))
    # the kept series are counted over the same rows
    return merge_rare(written(rows), "series", min_cases).select(
        "case_no", "year", "split", "masked_text", "rules", "label_source", "labels")


def split_summary(dataset: DataFrame) -> DataFrame:
    """Cases per split, how many have no label, and how many got theirs from the summary or OCR."""
    return dataset.groupBy("split").agg(
        F.count("*").alias("cases"), F.count_if(F.col("labels") == "").alias("no_label"),
        F.count_if(F.col("label_source") == "summary").alias("from_summary"),
        F.count_if(F.col("label_source") == "ocr").alias("from_ocr"))


def series_counts(df: DataFrame, rules: str = "rules", min_cases: int = C.MIN_SERIES_CASES) -> DataFrame:
    """Training cases per series and whether the series is merged."""
    return (df.select(F.explode(R.label_series(key_set(F.col(rules)))).alias("series"))
            .groupBy("series").agg(F.count("*").alias("train_cases"))
            .withColumn("merged_to_other", F.col("train_cases") < min_cases))


def class_list(dataset: DataFrame, split: str = "train") -> DataFrame:
    """Distinct labels of a split."""
    return (dataset.filter(F.col("split") == split)
            .select(F.explode(split_keys(F.col("labels"))).alias("series")).distinct())


def collected_classes(dataset: DataFrame, split: str = "train") -> list[str]:
    """The class names on the driver, sorted, for output that has a column per class."""
    return [r.series for r in class_list(dataset, split).orderBy("series").collect()]


def all_classes(dataset: DataFrame, split: str = "train") -> Column:
    """The sorted class names of a split as one array that each row can use; they stay on the executors."""
    return class_list(dataset, split).agg(F.sort_array(F.collect_list("series"))).scalar()


def binarized(dataset: DataFrame, classes: Column | Sequence[str], keep: Sequence[str] = ("case_no",)) -> DataFrame:
    """One row per (case, class) with y = 1 where the case has the label."""
    names = classes if isinstance(classes, Column) else F.array(*[F.lit(c) for c in classes])
    rows = dataset.select(*keep, split_keys(F.col("labels")).alias("_have"), names.alias("_classes"))
    per_class = F.transform("_classes", lambda c: F.struct(c.alias("series"), F.array_contains("_have", c).cast("int").alias("y")))
    return rows.select(*keep, F.inline(per_class))


def pos_weights(labelled: DataFrame, cap: float = 10.0) -> DataFrame:
    """Weight on positive cases per class: sqrt(negatives / positives), between 1 and ``cap``."""
    pos, n = F.sum("y"), F.count("*")
    return labelled.groupBy("series").agg(
        F.least(F.lit(cap), F.greatest(F.lit(1.0), F.sqrt((n - pos) / F.greatest(pos, F.lit(1))))).alias("weight"))


def coverage(cases: DataFrame, index: DataFrame, key: str = "case_no") -> DataFrame:
    """How many cases there are and how many have a row in the index."""
    have = index.select(key).distinct().withColumn("_have", F.lit(1))
    return cases.join(have, key, "left").agg(F.count("*").alias("cases"), F.count("_have").alias("covered"))


def missing_keys(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).join(have.select(key), key, "left_anti")


def require_complete(wanted: DataFrame, have: DataFrame, key: str) -> None:
    """Raise unless every wanted key is present, naming up to ten that are not."""
    left = [r[0] for r in missing_keys(wanted, have, key).orderBy(key).limit(10).collect()]
    if left:
        raise ValueError(f"missing {key}: {left}")


def unmapped_nasd(dataset: DataFrame, splits: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """NASD rules without a successor, counted by split, with a total."""
    keys = dataset.select("split", F.explode(key_set(F.col("rules"))).alias("key"))
    left = keys.filter(F.col("key").startswith("NASD:") & (R.successor(F.col("key")) == F.col("key")))
    table = left.select("split", R.number_of(F.col("key")).alias("rule")).groupBy("rule").pivot("split", list(splits)).count()
    counts = [F.coalesce(F.col(s), F.lit(0)).alias(s) for s in splits]
    return table.select("rule", *counts).withColumn("total", sum((F.col(s) for s in splits[1:]), F.col(splits[0])))


def above_numbering_cases(labels: DataFrame) -> DataFrame:
    """Cases with a FINRA or NASD key above the highest number that exists, and those keys."""
    odd = F.filter(split_keys(F.col("rules")), R.above_numbering)
    return labels.withColumn("odd_keys", odd).filter(F.size("odd_keys") > 0)


def evidence(sentences: Column, keys: Column, most: int = 3) -> Column:
    """The first sentences that contain one of the keys' numbers."""
    numbers = F.transform(keys, R.number_of)
    return F.slice(F.filter(sentences, lambda s: F.exists(numbers, lambda n: F.contains(s, n))), 1, most)
