"""Queries over derived answers and judgments: an order's items are what an answer cites and was shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions.arrays import joined
from casemill.operators import answers as A
from casemill.queries import derived as D
from casemill.sources import files as S
from casemill.sources.session import scratch_path

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def _raw(spark, d):
    """Model output per order: items over quantity 15 were shown, items under 6% discount are cited."""
    n = D.number(F.col("l_partkey"))
    shown = F.sort_array(F.collect_set(F.when(F.col("l_quantity") > 15, F.concat(n, F.lit(".01")))))
    cited = F.sort_array(F.collect_list(F.when(F.col("l_discount") < 0.06, F.struct(
        F.concat(F.lit("FINRA Rule "), n, F.lit("(a)")).alias("rule"), F.col("l_returnflag").alias("reason")))))
    rows = D.table(spark, d, "lineitem").groupBy("l_orderkey").agg(joined(shown).alias("chunk_rules"), F.to_json(cited).alias("reasons"))
    return rows.join(D.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("case").alias("kind"), F.col("o_orderkey").cast("string").alias("item_id"), F.lit("test").alias("split"),
        F.col("o_orderpriority").alias("question"), "chunk_rules", (F.col("o_orderstatus") == "P").alias("decline"), "reasons",
        F.lit("").alias("answer"), F.lit("m").alias("model"), F.when(F.col("o_orderpriority") < "3", "v1").otherwise("v2").alias("prompt"))


def _answers(spark, d):
    return A.answered(_raw(spark, d))


_ANSWERS = """items AS (SELECT l_orderkey, CAST(1000 + l_partkey % 900 * 10 AS VARCHAR) AS num, l_quantity > 15 AS shown, l_discount < 0.06 AS cited, l_returnflag FROM lineitem),
  per AS (SELECT l_orderkey, coalesce(list(DISTINCT num) FILTER (WHERE shown), []) AS shown, coalesce(list(num ORDER BY num, l_returnflag) FILTER (WHERE cited), []) AS cited FROM items GROUP BY l_orderkey),
  kept AS (SELECT *, list_filter(cited, lambda c: list_contains(shown, c)) AS k FROM per),
  answers AS (SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderkey, o_orderpriority, CASE WHEN o_orderpriority < '3' THEN 'v1' ELSE 'v2' END AS prompt,
    o_orderstatus = 'P' OR len(k) = 0 AS decline, CASE WHEN o_orderstatus = 'P' THEN '' ELSE array_to_string(list_sort(list_distinct(k)), '|') END AS rules,
    CAST(len(cited) - len(k) AS INTEGER) AS outside, shown FROM kept JOIN orders ON l_orderkey = o_orderkey)"""


@query("WITH " + _ANSWERS + " SELECT item_id, decline, rules, outside FROM answers")
def cited_filter(spark, d):
    return _answers(spark, d).select("item_id", "decline", "rules", "outside")


@query("WITH " + D.LINES + """ SELECT CAST(l_orderkey AS VARCHAR) AS item_id, 'FINRA Rule ' || CAST(1000 + l_partkey % 900 * 10 AS VARCHAR) || '(a)' AS rule,
  l_returnflag AS reason FROM lines WHERE l_discount < 0.06""")
def cited_rows(spark, d):
    return _raw(spark, d).select("item_id", F.inline(S.parse_cited(F.col("reasons"))))


def _judgments(spark, d):
    """The judge's label for orders that are not open, on prompt v2 answers, stored in an older and a newer run."""
    rows = D.table(spark, d, "orders").filter("o_orderstatus <> 'O'")
    return rows.select(F.col("o_orderkey").cast("string").alias("item_id"), F.lit("test").alias("split"),
                       F.when(F.col("o_totalprice") > 200000, "correct").otherwise("incorrect").alias("label"), F.lit("").alias("reason"),
                       F.lit("m").alias("model"), F.lit("v1").alias("prompt"), F.lit("v2").alias("answer_prompt"))


_JUDGED = "WITH " + _ANSWERS + """, judged AS (SELECT a.*, CASE WHEN o.o_orderstatus <> 'O' AND prompt = 'v2' THEN CASE WHEN o_totalprice > 200000 THEN 'correct' ELSE 'incorrect' END END AS judge
    FROM answers a JOIN orders o ON a.o_orderkey = o.o_orderkey)"""


@query(_JUDGED + " SELECT item_id, prompt, judge FROM judged")
def judged_answers(spark, d):
    return A.judged(_answers(spark, d), _judgments(spark, d), "v1").select("item_id", "prompt", "judge")


@query(_JUDGED + " SELECT item_id FROM judged WHERE judge IS NULL")
def answers_to_judge(spark, d):
    return A.to_judge(_answers(spark, d), _judgments(spark, d), "m", "v1").select("item_id")


_GOLD = _JUDGED + ", " + D.LINES + ", " + D.SUCCESSORS + f""", moved AS (SELECT DISTINCT l_orderkey, coalesce(new, key) AS k FROM lines LEFT JOIN succ ON key = old),
  gold AS (SELECT CAST(l_orderkey AS VARCHAR) AS item_id, list(split_part(k, ':', 2)) AS gold FROM moved WHERE k LIKE 'FINRA:%' AND NOT {D.not_charged('k')} GROUP BY l_orderkey),
  full_rows AS (SELECT j.item_id, decline, outside, judge, gold, list_filter(CASE WHEN rules = '' THEN [] ELSE string_split(rules, '|') END, lambda r: r <> '2010') AS cited,
    len(list_intersect(shown, gold)) > 0 AS retrieved FROM judged j JOIN gold g ON j.item_id = g.item_id),
  r AS (SELECT *, len(list_intersect(cited, gold)) AS hits FROM full_rows)"""


def _with_gold(spark, d):
    keys = D.lines(spark, d).groupBy(F.col("l_orderkey").cast("string").alias("case_no")).agg(joined(F.sort_array(F.collect_set("key"))).alias("rules"))
    return A.with_gold(A.judged(_answers(spark, d), _judgments(spark, d), "v1"), keys)


@query(_GOLD + """ SELECT count(*) AS cases, round(avg(CASE WHEN decline THEN 1 ELSE 0 END), 6) AS declined, round(avg(CASE WHEN retrieved THEN 1 ELSE 0 END), 6) AS charged_rule_retrieved,
  round(avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END), 6) AS charged_rule_cited, round(sum(hits) / sum(len(cited)), 6) AS precision, round(sum(hits) / sum(len(gold)), 6) AS recall,
  sum(outside) AS outside, round(avg(CASE WHEN judge = 'correct' THEN 1 ELSE 0 END), 6) AS judge_correct, count(judge) AS judged,
  count(*) FILTER (WHERE decline AND retrieved) AS declined_with_rule_shown, count(*) FILTER (WHERE NOT decline AND hits = 0) AS no_charged_rule_cited FROM r""")
def answer_report(spark, d):
    got = A.answer_report(_with_gold(spark, d))
    return got.select(*[D.r6(c).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


@query(_GOLD + " SELECT item_id, array_to_string(list_sort(gold), '|') AS gold FROM r WHERE decline AND retrieved ORDER BY item_id LIMIT 8")
def declined_with_rule_shown(spark, d):
    return A.declined_with_rule_shown(_with_gold(spark, d)).select("item_id", "gold")


@query(_GOLD + """ SELECT item_id, array_to_string(list_sort(gold), '|') AS gold, array_to_string(list_sort(cited), '|') AS cited FROM r
  WHERE NOT decline AND hits = 0 ORDER BY item_id LIMIT 8""")
def without_charged_rule(spark, d):
    return A.without_charged_rule(_with_gold(spark, d))


def _questions(spark, d):
    rows = D.table(spark, d, "orders")
    return rows.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("q").alias("question"), F.col("o_orderstatus").alias("governing_source"),
                       F.when(F.col("o_totalprice") > 100000, " y ").otherwise("N").alias("keep"))


@query("WITH " + _ANSWERS + """ SELECT count(*) AS questions, sum(CASE WHEN decline THEN 1 ELSE 0 END) AS declined FROM answers a JOIN orders o ON a.o_orderkey = o.o_orderkey
  WHERE o_totalprice > 100000""")
def decline_counts(spark, d):
    return A.decline_counts(_questions(spark, d), _answers(spark, d))


@query("WITH " + _ANSWERS + """ SELECT item_id AS id, o_orderstatus AS governing_source, rules FROM answers a JOIN orders o ON a.o_orderkey = o.o_orderkey
  WHERE o_totalprice > 100000 AND NOT decline""")
def answered_questions(spark, d):
    return A.answered_questions(_questions(spark, d), _answers(spark, d)).select("id", "governing_source", "rules")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS case_no, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'P'")
def invalid_labels(spark, d):
    rows = D.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("case_no"), F.when(F.col("o_orderstatus") == "F", " Correct").when(
        F.col("o_orderstatus") == "O", "incorrect").otherwise(F.col("o_orderpriority")).alias("label"))
    return A.invalid_labels(rows)


@query(_GOLD + """, h AS (SELECT r.item_id, CASE WHEN o_orderpriority < '4' THEN 'correct' ELSE 'incorrect' END AS hand, judge FROM r JOIN orders ON r.item_id = CAST(o_orderkey AS VARCHAR)
    WHERE judge IS NOT NULL),
  t AS (SELECT count(*) AS n, sum(CASE WHEN hand = judge THEN 1 ELSE 0 END) AS agree, sum(CASE WHEN hand = 'correct' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN judge = 'correct' THEN 1 ELSE 0 END) AS b FROM h),
  e AS (SELECT *, (a * b + (n - a) * (n - b)) / (n * n) AS pe FROM t)
  SELECT n, round(agree / n, 6) AS agreement, round((agree / n - pe) / (1 - pe), 6) AS kappa FROM e""")
def judge_kappa(spark, d):
    judged = _with_gold(spark, d).filter("judge is not null")
    hand = D.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("case_no"), F.when(
        F.col("o_orderpriority") < "4", "CORRECT ").otherwise("incorrect").alias("label"))
    return A.judge_kappa(hand, judged).withColumn("agreement", D.r6("agreement")).withColumn("kappa", D.r6("kappa"))


@query(_GOLD + """, c AS (SELECT l_orderkey, string_agg('FINRA Rule ' || num || '(a): ' || l_returnflag, ' | ' ORDER BY 'FINRA Rule ' || num || '(a)', l_returnflag) AS listed FROM items WHERE cited GROUP BY l_orderkey)
  SELECT r.item_id AS case_no, array_to_string(list_sort(gold), ', ') AS finra_charged, CASE WHEN decline THEN 'true' ELSE 'false' END AS declined,
    CASE WHEN decline THEN '' ELSE coalesce(listed, '') END AS answer_rules, '' AS label, '' AS notes FROM r LEFT JOIN c ON r.item_id = CAST(c.l_orderkey AS VARCHAR)""")
def hand_label_sheet(spark, d):
    """The sheet written as CSV and read back as strings."""
    sheet = A.hand_label_sheet(_with_gold(spark, d))
    path = scratch_path(spark, "sheet")
    S.write_csv(sheet, path)
    return S.read_csv_strings(spark, path, sheet.columns)


@query("SELECT lang || ':' || source AS key FROM documents GROUP BY lang, source")
def line_list(spark, d):
    """Keys written to a text file between comments and blank lines, and read back."""
    docs = D.table(spark, d, "documents", "lang", "source").distinct()
    rows = docs.select(F.explode(F.array(F.concat_ws(":", F.lit("# skip"), "lang"), F.concat(F.lit("  "), F.concat_ws(":", "lang", "source")), F.lit("   "))).alias("value"))
    path = scratch_path(spark, "list")
    rows.write.text(path)
    return S.read_line_list(spark, path)


@query("WITH " + D.CASES + """ SELECT case_no, doc_rules, len(string_split(doc_rules, '|')) AS n FROM cases WHERE doc_rules <> ''""")
def json_records(spark, d):
    """Hand-check records with nested lists written as JSON and read back."""
    rows = D.cases(spark, d).filter("doc_rules <> ''").select("case_no", "doc_rules", F.split("doc_rules", r"\|").alias("sentences"))
    path = scratch_path(spark, "records")
    S.write_json_records(rows, path)
    return spark.read.schema(rows.schema).json(path).select("case_no", "doc_rules", F.size("sentences").alias("n"))


