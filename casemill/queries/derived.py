"""Case tables derived from the given tables, in Spark and as SQL common table expressions.

Orders stand for cases and their line items for cited rules; the texts are built from them, so what a text
job must find in a text is known from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.functions.arrays import joined
from casemill.operators.labels import all_classes, binarized, build_dataset, case_labels
from casemill.sources.session import written
from casemill.sources.tables import load_table, spread, tasks

YEARS = {"train": (1995, 1998), "validation": (1999, 1999), "test": (2000, 2001)}
MIN_CASES = C.MIN_SERIES_CASES


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return load_table(spark, f"{folder}/{name}.parquet", columns=columns or None)


def r6(value: Column | str) -> Column:
    return F.round(value, 6)


def number(partkey: Column) -> Column:
    return (1000 + partkey % 900 * 10).cast("string")


def _pick(partkey: Column, options: list[Column]) -> Column:
    chosen = F.when(partkey % len(options) == 0, options[0])
    for i, o in enumerate(options[1:], 1):
        chosen = chosen.when(partkey % len(options) == i, o)
    return chosen


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a rule key each."""
    p = F.col("l_partkey")
    key = _pick(p, [F.concat(F.lit("FINRA:"), number(p)), F.concat(F.lit("NASD:"), number(p)),
                    F.concat(F.lit("MSRB:G-"), (p % 40 + 1).cast("string")),
                    F.concat(F.lit("SEC_RULE:17a-"), (p % 20 + 1).cast("string"))])
    return table(spark, folder, "lineitem").withColumn("key", key)


LINES = """lines AS (
  SELECT *, CASE l_partkey % 4 WHEN 0 THEN 'FINRA:' || num WHEN 1 THEN 'NASD:' || num
    WHEN 2 THEN 'MSRB:G-' || CAST(l_partkey % 40 + 1 AS VARCHAR)
    ELSE 'SEC_RULE:17a-' || CAST(l_partkey % 20 + 1 AS VARCHAR) END AS key
  FROM (SELECT *, CAST(1000 + l_partkey % 900 * 10 AS VARCHAR) AS num FROM lineitem))"""


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with items: case columns and three rule sources."""
    rows = lines(spark, folder).join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    def keys(condition: Column) -> Column:
        return joined(F.sort_array(F.collect_set(F.when(condition, F.col("key")))))
    grouped = rows.groupBy("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_custkey").agg(
        keys(F.col("l_discount") <= 0.06).alias("doc_rules"),
        keys((F.col("l_tax") <= 0.03) & (F.col("o_orderkey") % 5 != 0)).alias("summary_rules"),
        keys(F.lit(True)).alias("ocr_rules"))
    return grouped.select(
        F.col("o_orderkey").cast("string").alias("case_no"), "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate")).alias("action_date"),
        F.date_format("o_orderdate", "yyyy-MM").alias("report_month"), F.col("o_orderpriority").alias("section"),
        "doc_rules", "summary_rules", "ocr_rules",
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"), "ocr_rules").alias("masked_text"))


CASES = LINES + """, cases AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS case_no, o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS action_date,
    strftime(o_orderdate, '%Y-%m') AS report_month, o_orderpriority AS section, doc_rules, summary_rules, ocr_rules,
    o_orderpriority || ' ' || o_orderstatus || ' ' || CAST(o_custkey AS VARCHAR) || ' ' || ocr_rules AS masked_text
  FROM (SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_custkey,
      coalesce(array_to_string(list_sort(list(DISTINCT key) FILTER (WHERE l_discount <= 0.06)), '|'), '') AS doc_rules,
      coalesce(array_to_string(list_sort(list(DISTINCT key) FILTER (WHERE l_tax <= 0.03 AND o_orderkey % 5 <> 0)), '|'), '') AS summary_rules,
      array_to_string(list_sort(list(DISTINCT key)), '|') AS ocr_rules
    FROM lines JOIN orders ON l_orderkey = o_orderkey
    GROUP BY o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_custkey))"""


def labels_of(all_cases: DataFrame) -> DataFrame:
    return case_labels(all_cases, all_cases, all_cases)


LABELS = CASES + """, labels AS (
  SELECT case_no, CASE WHEN doc_rules <> '' THEN doc_rules WHEN summary_rules <> '' THEN summary_rules
      WHEN ocr_rules <> '' THEN ocr_rules ELSE '' END AS rules,
    CASE WHEN doc_rules <> '' THEN 'document' WHEN summary_rules <> '' THEN 'summary'
      WHEN ocr_rules <> '' THEN 'ocr' END AS label_source
  FROM cases)"""


def dataset(spark: SparkSession, folder: str, min_cases: int = MIN_CASES) -> DataFrame:
    # written: the dataset reads the cases four times
    all_cases = written(cases(spark, folder))
    return build_dataset(all_cases, labels_of(all_cases), min_cases, **YEARS)


SUCCESSORS = "succ(old, new) AS (VALUES " + ", ".join(
    f"('NASD:{a}', 'FINRA:{b}')" for a, b in C.NASD_SUCCESSOR.items()) + ")"


def not_charged(k: str) -> str:
    """SQL condition: the catch-all or a procedural key."""
    return (f"({k} = 'FINRA:2010' OR {k} IN ('SEC_SECTION:19', 'SEC_SECTION:15A') "
            f"OR regexp_full_match({k}, 'FINRA:(9\\d|01)\\d\\d'))")


def series(k: str) -> str:
    """SQL expression: the series label of a key."""
    return (f"CASE WHEN split_part({k}, ':', 1) IN ('FINRA', 'NASD') AND regexp_extract({k}, ':(IM-)?(\\d+)', 2) <> '' "
            f"THEN split_part({k}, ':', 1) || ':' || CAST(CAST(regexp_extract({k}, ':(IM-)?(\\d+)', 2) AS INTEGER) // 1000 * 1000 AS VARCHAR) "
            f"ELSE split_part({k}, ':', 1) END")


def dataset_sql(min_cases: int = MIN_CASES) -> str:
    return LABELS + ", " + SUCCESSORS + f""", dated AS (
  SELECT c.case_no, c.masked_text, l.rules, l.label_source,
    coalesce(year(c.action_date), CAST(substr(c.report_month, 1, 4) AS INTEGER)) AS year
  FROM cases c JOIN labels l ON c.case_no = l.case_no WHERE l.rules <> ''
), splits AS (
  SELECT *, CASE WHEN year BETWEEN 1995 AND 1998 THEN 'train' WHEN year = 1999 THEN 'validation'
    WHEN year BETWEEN 2000 AND 2001 THEN 'test' END AS split FROM dated
), case_keys AS (
  SELECT case_no, split, rules, unnest(string_split(rules, '|')) AS raw FROM splits WHERE split IS NOT NULL
), moved AS (
  SELECT case_no, split, raw, coalesce(new, raw) AS k FROM case_keys LEFT JOIN succ ON raw = old
), case_series AS (
  SELECT DISTINCT case_no, split, {series('k')} AS s FROM moved WHERE NOT {not_charged('k')}
), kept AS (
  SELECT s FROM case_series WHERE split = 'train' GROUP BY s HAVING count(*) >= {min_cases}
), case_labels AS (
  SELECT DISTINCT case_no, CASE WHEN s IN (SELECT s FROM kept) THEN s ELSE 'other' END AS label FROM case_series
), joined_labels AS (
  SELECT case_no, string_agg(label, '|' ORDER BY label) AS labels FROM case_labels GROUP BY case_no
), dataset AS (
  SELECT s.case_no, s.year, s.split, s.masked_text, s.rules, s.label_source, coalesce(j.labels, '') AS labels
  FROM splits s LEFT JOIN joined_labels j ON s.case_no = j.case_no WHERE s.split IS NOT NULL)"""


DATASET = dataset_sql()
MODELS = ("baseline", "finetune", "zeroshot")


def class_number(series_name: Column) -> Column:
    """A number of a class that both engines compute: from the name's length and digits."""
    digits = F.coalesce(F.nullif(F.regexp_replace(series_name, "[^0-9]", ""), F.lit("")), F.lit("0"))
    return F.length(series_name) * 31 + F.floor(digits.cast("int") / 1000)


def probability(case: Column, series_name: Column, model_no: int, y: Column) -> Column:
    """Predicted probabilities that lean towards the truth, in thousandths."""
    h = case * 7919 + class_number(series_name) * 104729 + model_no * 1299709
    return F.when(y == 1, 350 + h % 651).otherwise(h % 620) / 1000.0


def predictions(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    """Long predictions of three models for the cases of a split."""
    data = written(dataset(spark, folder).select("case_no", "split", "labels"))
    truth = binarized(data.filter(F.col("split") == split), all_classes(data))
    per_model = F.array(*[F.struct(F.lit(m).alias("model"), probability(
        F.col("case_no").cast("bigint"), F.col("series"), i, F.col("y")).alias("p")) for i, m in enumerate(MODELS)])
    return truth.select("case_no", "series", "y", F.inline(per_model)).select("case_no", "model", "series", "y", "p")


def predictions_sql(split: str = "test") -> str:
    return DATASET + f""", classes AS (
  SELECT DISTINCT unnest(string_split(labels, '|')) AS series FROM dataset WHERE split = 'train' AND labels <> ''
), numbered AS (
  SELECT series, length(series) * 31 + CAST(coalesce(nullif(regexp_replace(series, '[^0-9]', '', 'g'), ''), '0') AS INTEGER) // 1000 AS c
  FROM classes
), truth AS (
  SELECT d.case_no, n.series, n.c, CASE WHEN list_contains(string_split(d.labels, '|'), n.series) THEN 1 ELSE 0 END AS y
  FROM dataset d CROSS JOIN numbered n WHERE d.split = '{split}'
), models(model, m) AS (VALUES ('baseline', 0), ('finetune', 1), ('zeroshot', 2)
), preds AS (
  SELECT case_no, model, series, y,
    (CASE WHEN y = 1 THEN 350 + (CAST(case_no AS BIGINT) * 7919 + c * 104729 + m * 1299709) % 651
      ELSE (CAST(case_no AS BIGINT) * 7919 + c * 104729 + m * 1299709) % 620 END) / 1000.0 AS p
  FROM truth CROSS JOIN models)"""


def phrase(partkey: Column) -> Column:
    """A citation as it stands in a text."""
    n = number(partkey)
    s = lambda m: (partkey % m + 1).cast("string")
    return _pick(partkey, [
        F.concat(F.lit("FINRA Rule "), n, F.lit("(a)")), F.concat(F.lit("NASD Rule "), n),
        F.concat(F.lit("MSRB Rule G-"), s(40)), F.concat(F.lit("Exchange Act Rule 17a-"), s(20)),
        F.concat(F.lit("Exchange Act Section "), s(30), F.lit("(b)")),
        F.concat(F.lit("Section "), s(30), F.lit(" of the Securities Act")),
        F.concat(F.lit("Regulation NMS Rule 6"), F.lpad((partkey % 14).cast("string"), 2, "0")),
        F.concat(F.lit("Nasdaq Rule "), n)])


PHRASES = """phrased AS (
  SELECT *, CASE l_partkey % 8 WHEN 0 THEN 'FINRA Rule ' || num || '(a)' WHEN 1 THEN 'NASD Rule ' || num
    WHEN 2 THEN 'MSRB Rule G-' || CAST(l_partkey % 40 + 1 AS VARCHAR)
    WHEN 3 THEN 'Exchange Act Rule 17a-' || CAST(l_partkey % 20 + 1 AS VARCHAR)
    WHEN 4 THEN 'Exchange Act Section ' || CAST(l_partkey % 30 + 1 AS VARCHAR) || '(b)'
    WHEN 5 THEN 'Section ' || CAST(l_partkey % 30 + 1 AS VARCHAR) || ' of the Securities Act'
    WHEN 6 THEN 'Regulation NMS Rule 6' || lpad(CAST(l_partkey % 14 AS VARCHAR), 2, '0')
    ELSE 'Nasdaq Rule ' || num END AS phrase,
   CASE l_partkey % 8
    WHEN 0 THEN CASE WHEN num IN ('2110','2510','3010','3030','3040','3050') THEN 'NASD:' ELSE 'FINRA:' END || num
    WHEN 1 THEN CASE WHEN num IN ('2010','3270','3280') THEN 'FINRA:' ELSE 'NASD:' END || num
    WHEN 2 THEN 'MSRB:G-' || CAST(l_partkey % 40 + 1 AS VARCHAR)
    WHEN 3 THEN 'SEC_RULE:17a-' || CAST(l_partkey % 20 + 1 AS VARCHAR)
    WHEN 4 THEN 'SEC_SECTION:' || CAST(l_partkey % 30 + 1 AS VARCHAR)
    WHEN 5 THEN 'SA_SECTION:' || CAST(l_partkey % 30 + 1 AS VARCHAR)
    WHEN 6 THEN 'REG_NMS:6' || lpad(CAST(l_partkey % 14 AS VARCHAR), 2, '0')
    ELSE 'EXCHANGE:' || num END AS cited,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_extendedprice, l_suppkey, l_linestatus, l_shipdate) AS place
  FROM (SELECT *, CAST(1000 + l_partkey % 900 * 10 AS VARCHAR) AS num FROM lineitem))"""


def ordered_lines(spark: SparkSession, folder: str, *fields: Column) -> DataFrame:
    """(l_orderkey, lines): an order's items as one array in a total order, with the given fields."""
    sort = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice", "l_suppkey", "l_linestatus",
                               "l_shipdate")]
    items = F.sort_array(F.collect_list(F.struct(*sort, phrase(F.col("l_partkey")).alias("phrase"), *fields)))
    rows = table(spark, folder, "lineitem")
    # dealt out first: the scan of a few large row groups collects nothing, and an order's text is worked on in the task that
    # collects its items, so neither a scan's few tasks nor partitions merged by their small size hold the heavy work
    dealt = rows.repartition(tasks(rows), "l_orderkey")
    return dealt.groupBy("l_orderkey").agg(items.alias("lines"))


FILLER = "Respondent was registered with the firm during the relevant period and left it later that year. "
WAIVER = " II. WAIVER OF PROCEDURAL RIGHTS Respondent waives any claim that a person violated FINRA Rule 9143."


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """A case document per order: one sentence per item, charging, reviewing or waiving its rule."""
    sentence = F.transform("lines", lambda x: F.concat(
        F.when(x["l_returnflag"] == "N", "The firm, fined $2.5 million, violated ")
        .when(x["l_returnflag"] == "R", "Staff reviewed trades under ")
        .otherwise("He waives the claim that he violated "), x["phrase"], F.lit(".")))
    rows = ordered_lines(spark, folder)
    return rows.select(
        F.col("l_orderkey").cast("string").alias("case_no"),
        F.concat(F.lit(FILLER * 6), F.lit("FACTS AND VIOLATIVE CONDUCT Smith sold\nnotes in lot "),
                 F.size("lines").cast("string"), F.lit(". "), F.array_join(sentence, " "), F.lit(WAIVER)).alias("text"))


def spread_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    return spread(table(spark, folder, name), key)
