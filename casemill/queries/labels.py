"""Queries over derived cases: labels, dataset, joins, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import rules as R
from casemill.functions.arrays import joined, key_set
from casemill.operators import labels as L
from casemill.operators import metrics as M
from casemill.operators import ordering as O
from casemill.queries import derived as D
from casemill.schemas import OCR_LABELS
from casemill.sources.session import scratch_path, written
from casemill.sources.tables import (add_column_default, append_runs, load_evolved, load_table, not_yet_run,
                                     optional_table, replace_table)

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


@query("WITH " + D.LABELS + " SELECT case_no, rules, label_source FROM labels")
def case_labels(spark, d):
    return D.labels_of(D.cases(spark, d))


@query("WITH " + D.LABELS + """ SELECT coalesce(label_source, 'none') AS label_source, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 1""")
def label_source_counts(spark, d):
    rows = D.labels_of(D.cases(spark, d)).withColumn("label_source", F.coalesce("label_source", F.lit("none")))
    return M.value_shares(rows, "label_source").withColumn("share", D.r6("share"))


@query("WITH " + D.DATASET + " SELECT case_no, year, split, masked_text, rules, label_source, labels FROM dataset")
def dataset_build(spark, d):
    return D.dataset(spark, d)


@query("WITH " + D.DATASET + """ SELECT split, count(*) AS cases, count(*) FILTER (WHERE labels = '') AS no_label,
  count(*) FILTER (WHERE label_source = 'summary') AS from_summary, count(*) FILTER (WHERE label_source = 'ocr') AS from_ocr
  FROM dataset GROUP BY split""")
def split_summary(spark, d):
    return L.split_summary(D.dataset(spark, d))


@query("WITH " + D.DATASET + f""" SELECT s AS series, count(*) AS train_cases, count(*) < {D.MIN_CASES} AS merged_to_other
  FROM case_series WHERE split = 'train' GROUP BY s""")
def series_counts(spark, d):
    return L.series_counts(D.dataset(spark, d).filter("split = 'train'"), min_cases=D.MIN_CASES)


@query("WITH " + D.dataset_sql(1000) + """ SELECT split, label, count(*) AS cases FROM (SELECT split, unnest(string_split(labels, '|')) AS label FROM dataset)
  WHERE label <> '' GROUP BY ALL""")
def rare_classes_merged(spark, d):
    """Label counts per split where series with fewer than 1,000 training cases are merged."""
    rows = D.dataset(spark, d, 1000).select("split", F.explode(F.split("labels", r"\|")).alias("label"))
    return rows.filter("label <> ''").groupBy("split", "label").agg(F.count("*").alias("cases"))


@query("WITH " + D.DATASET + """ SELECT DISTINCT unnest(string_split(labels, '|')) AS series FROM dataset
  WHERE split = 'train' AND labels <> ''""")
def class_list(spark, d):
    return L.class_list(D.dataset(spark, d))


@query("WITH " + D.predictions_sql("validation") + " SELECT case_no, series, y FROM truth")
def binarized_labels(spark, d):
    data = written(D.dataset(spark, d))
    return L.binarized(data.filter("split = 'validation'"), L.all_classes(data))


@query("WITH " + D.predictions_sql("train") + """ SELECT series, round(least(10, greatest(1,
  sqrt((count(*) - sum(y)) / greatest(sum(y), 1)))), 6) AS weight FROM truth GROUP BY series""")
def pos_weights(spark, d):
    data = written(D.dataset(spark, d))
    truth = L.binarized(data.filter("split = 'train'"), L.all_classes(data))
    return L.pos_weights(truth).withColumn("weight", D.r6("weight"))


@query("WITH " + D.DATASET + f""", gold AS (SELECT DISTINCT case_no, upper(split_part(k, ':', 2)) AS r FROM moved
  WHERE k LIKE 'FINRA:%' AND NOT {D.not_charged('k')})
  SELECT d.case_no, coalesce(string_agg(r, '|' ORDER BY r), '') AS rules FROM dataset d LEFT JOIN gold g ON d.case_no = g.case_no
  GROUP BY d.case_no""")
def rulebook_rules(spark, d):
    return D.dataset(spark, d).select("case_no", joined(R.rulebook_rules_of(F.col("rules"))).alias("rules"))


@query("WITH " + D.LINES + ", " + D.SUCCESSORS + f""" SELECT key, coalesce(new, key) AS successor,
  {D.series('coalesce(new, key)')} AS series,
  regexp_full_match(coalesce(new, key), 'FINRA:(9\\d|01)\\d\\d') AS procedural, count(*) AS n
  FROM lines LEFT JOIN succ ON key = old GROUP BY key, new""")
def key_lookups(spark, d):
    new = R.successor(F.col("key"))
    return D.lines(spark, d).groupBy("key").agg(F.count("*").alias("n")).select(
        "key", new.alias("successor"), R.series_label(new).alias("series"), R.is_procedural(new).alias("procedural"), "n")


@query("""WITH raw AS (SELECT l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'FINRA' ELSE 'NASD' END AS family,
    CAST(1000 + l_partkey % 900 * 10 AS VARCHAR) AS num, l_linenumber AS ln FROM lineitem),
  written AS (SELECT family, num, CASE ln % 4 WHEN 0 THEN num || '(a)(1)' WHEN 1 THEN num || 'A' WHEN 2 THEN num || '.05'
    ELSE num || '7' END AS rule, ln FROM raw),
  based AS (SELECT family, rule, CASE WHEN ln % 4 <> 3 THEN num
      WHEN family = 'FINRA' AND CAST(rule AS INTEGER) BETWEEN 11000 AND 14999 THEN rule
      WHEN family = 'NASD' AND CAST(rule AS INTEGER) BETWEEN 10000 AND 11999 THEN rule ELSE num END AS base FROM written)
  SELECT rule, family AS written_family, CASE WHEN family = 'FINRA' AND base IN ('2110','2510','3010','3011','3012','3013','3030','3040','3050')
      THEN 'NASD' WHEN family = 'NASD' AND base IN ('2010','2111','3270','3280','4511') THEN 'FINRA' ELSE family END AS family,
    base, count(*) AS n FROM based GROUP BY ALL""")
def normalised_rules(spark, d):
    p, at = F.col("l_partkey"), F.col("l_linenumber") % 4
    suffix = F.when(at == 0, "(a)(1)").when(at == 1, "A").when(at == 2, ".05").otherwise("7")
    rows = D.table(spark, d, "lineitem").select(
        F.when(p % 2 == 0, "FINRA").otherwise("NASD").alias("written_family"), F.concat(D.number(p), suffix).alias("rule"))
    counted = rows.groupBy("written_family", "rule").agg(F.count("*").alias("n"))
    return counted.withColumn("_r", R.normalise_rule(F.col("written_family"), F.col("rule"))).select(
        "rule", "written_family", "_r.family", "_r.base", "n")


@query("WITH " + D.CASES + """, done AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS case_no FROM orders WHERE o_orderstatus = 'F')
  SELECT count(*) AS cases, count(done.case_no) AS covered FROM cases LEFT JOIN done ON cases.case_no = done.case_no""")
def coverage(spark, d):
    done = D.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("case_no"))
    return L.coverage(D.cases(spark, d), done)


@query("""SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders r
  WHERE r.o_custkey = o.o_custkey AND r.o_orderpriority = o.o_orderpriority AND r.o_orderstatus = 'F')""")
def resume_anti(spark, d):
    """Orders whose customer has no finished order of the same priority."""
    orders = D.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return not_yet_run(orders.drop("o_orderstatus"), orders.filter("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"])


@query("""SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE EXISTS (SELECT 1 FROM orders r
  WHERE r.o_custkey = o.o_custkey AND r.o_orderpriority = o.o_orderpriority AND r.o_orderstatus = 'P')""")
def listed_cases(spark, d):
    """Orders whose customer has a pending order of the same priority."""
    orders = D.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return orders.join(orders.filter("o_orderstatus = 'P'").select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], "left_semi").drop("o_orderstatus")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority < '2')")
def completeness_gap(spark, d):
    pending = D.table(spark, d, "orders").filter("o_orderstatus = 'P' AND o_orderpriority < '2'")
    have = pending.select(F.col("o_custkey").alias("c_custkey"))
    return L.missing_keys(D.table(spark, d, "customer"), have, "c_custkey")


@query("WITH " + D.DATASET + """, left_over AS (SELECT split, split_part(raw, ':', 2) AS rule FROM moved
    WHERE raw LIKE 'NASD:%' AND raw NOT IN (SELECT old FROM succ))
  SELECT rule, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation,
    count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total FROM left_over GROUP BY rule""")
def unmapped_nasd(spark, d):
    return L.unmapped_nasd(D.dataset(spark, d))


_SETS = "WITH " + D.CASES + """, sets AS (SELECT case_no,
    CASE WHEN doc_rules = '' THEN [] ELSE string_split(doc_rules, '|') END AS p,
    CASE WHEN summary_rules = '' THEN [] ELSE string_split(summary_rules, '|') END AS t FROM cases)"""


@query(_SETS + """, sums AS (SELECT count(*) AS n, sum(len(list_intersect(p, t))) AS tp, sum(len(p) - len(list_intersect(p, t))) AS fp,
    sum(len(t) - len(list_intersect(p, t))) AS fn FROM sets)
  SELECT n AS "rows", round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    CASE WHEN tp / (tp + fp) >= 0.98 AND tp / (tp + fn) >= 0.98 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM sums""")
def set_precision_recall(spark, d):
    got = M.set_precision_recall(D.cases(spark, d), "doc_rules", "summary_rules")
    return got.withColumn("precision", D.r6("precision")).withColumn("recall", D.r6("recall"))


@query(_SETS + """ SELECT count(*) AS both, round(avg(CASE WHEN len(p) = len(t) AND len(list_intersect(p, t)) = len(p) THEN 1 ELSE 0 END), 6) AS identical,
    round(avg(len(list_intersect(p, t)) / (len(p) + len(t) - len(list_intersect(p, t)))), 6) AS jaccard
  FROM sets WHERE len(p) > 0 AND len(t) > 0""")
def set_agreement(spark, d):
    got = M.set_agreement(D.cases(spark, d), "doc_rules", "summary_rules")
    return got.withColumn("identical", D.r6("identical")).withColumn("jaccard", D.r6("jaccard"))


@query("WITH " + D.CASES + """ SELECT count(*) AS labelled, round(avg(CASE WHEN list_contains(string_split(ocr_rules, '|'), 'FINRA:2010')
    THEN 1 ELSE 0 END), 6) AS share FROM cases WHERE ocr_rules <> ''""")
def catch_all_share(spark, d):
    return M.catch_all_share(D.cases(spark, d), "ocr_rules").withColumn("share", D.r6("share"))


@query("""WITH keys AS (SELECT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN 'FINRA' ELSE 'NASD' END || ':' || CAST(5000 + l_partkey * 10 AS VARCHAR) AS key,
      5000 + l_partkey * 10 AS num, l_partkey % 2 AS fam FROM lineitem),
    odd AS (SELECT DISTINCT l_orderkey, key FROM keys WHERE (fam = 0 AND num > 14999) OR (fam = 1 AND num > 11999))
  SELECT CAST(l_orderkey AS VARCHAR) AS case_no, string_agg(key, '|' ORDER BY key) AS odd_keys FROM odd GROUP BY l_orderkey""")
def above_numbering(spark, d):
    p = F.col("l_partkey")
    key = F.concat(F.when(p % 2 == 0, "FINRA:").otherwise("NASD:"), (5000 + p * 10).cast("string"))
    rules = D.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("case_no")).agg(
        joined(F.sort_array(F.collect_set(key))).alias("rules"))
    return L.above_numbering_cases(rules).select("case_no", joined(F.col("odd_keys")).alias("odd_keys"))


@query("WITH " + D.CASES + """ SELECT case_no FROM cases WHERE doc_rules = '' AND summary_rules = '' AND o_orderstatus <> 'P'""")
def cases_needing_ocr(spark, d):
    all_cases = D.cases(spark, d)
    docs = all_cases.select("case_no", "doc_rules", F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("n_docs"))
    return L.cases_needing_ocr(all_cases, docs)


@query("WITH " + D.CASES + """, rows AS (SELECT substr(report_month, 1, 4) AS year, doc_rules, summary_rules FROM cases)
  SELECT year, count(*) AS cases, count(*) FILTER (WHERE doc_rules <> '') AS with_doc_labels,
    round(avg(CASE WHEN summary_rules <> '' THEN 1 ELSE 0 END), 3) AS summary_cites_any FROM rows GROUP BY year""")
def label_profile(spark, d):
    rows = D.cases(spark, d).withColumn("year", F.substring("report_month", 1, 4))
    return rows.groupBy("year").agg(
        F.count("*").alias("cases"), F.count_if(F.size(key_set(F.col("doc_rules"))) > 0).alias("with_doc_labels"),
        F.round(F.avg((F.size(key_set(F.col("summary_rules"))) > 0).cast("int")), 3).alias("summary_cites_any"))


@query("""WITH runs AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)
  SELECT user_id, event_type, n, 'v1' AS answer_prompt FROM runs""")
def appended_runs(spark, d):
    """Runs stored in two overlapping batches: each key is stored once."""
    runs = D.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    path = scratch_path(spark, "runs")
    append_runs(runs.filter("n >= 2"), path, ["user_id", "event_type"])
    append_runs(runs, path, ["user_id", "event_type"])
    return add_column_default(spark.read.parquet(path), "answer_prompt", "v1")


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'v1' ELSE o_orderpriority END AS answer_prompt FROM orders""")
def column_default(spark, d):
    """Files written before a column existed read with its default."""
    orders = D.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    path = scratch_path(spark, "evolved")
    orders.filter("o_orderstatus = 'F'").drop("o_orderpriority").write.parquet(path)
    orders.filter("o_orderstatus <> 'F'").withColumnRenamed("o_orderpriority", "answer_prompt").write.mode("append").parquet(path)
    return load_evolved(spark, path, "answer_prompt", "v1")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def keep_latest(spark, d):
    orders = D.table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return O.keep_latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def keep_first(spark, d):
    events = D.table(spark, d, "events", "user_id", "event_type", "event_id", "ts")
    return O.keep_first(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT month, o_orderkey AS pos, is_pdf FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY is_pdf DESC, o_orderkey) AS r
  FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_orderpriority = '1-URGENT' AS is_pdf FROM orders)) WHERE r = 1""")
def best_source(spark, d):
    rows = D.table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("pos"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_pdf"))
    return O.best_source(rows)


@query("WITH " + D.CASES + """, docs AS (SELECT o_custkey, o_orderkey, doc_rules, doc_rules <> '' AS has, count(*) OVER (PARTITION BY o_custkey) AS n_docs FROM cases),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY has DESC, CASE WHEN has THEN o_orderkey ELSE -o_orderkey END) AS r FROM docs)
  SELECT o_custkey, o_orderkey, doc_rules, n_docs FROM ranked WHERE r = 1""")
def first_doc_with_rules(spark, d):
    docs = D.cases(spark, d).select("o_custkey", "o_orderkey", "doc_rules")
    return O.first_with_result(docs, "o_custkey", F.col("doc_rules") != "", F.col("o_orderkey"))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS item, 0 AS source FROM orders WHERE o_orderstatus = 'F'),
    b AS (SELECT o_custkey AS k, o_orderkey AS item, 1 AS source FROM orders WHERE o_orderstatus = 'O'),
    c AS (SELECT c_custkey AS k, c_custkey AS item, 2 AS source FROM customer),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
    m AS (SELECT k, min(source) AS source FROM u GROUP BY k)
  SELECT u.k, u.source, u.item FROM u JOIN m ON u.k = m.k AND u.source = m.source""")
def fallback_sources(spark, d):
    orders = D.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"), "o_orderstatus")
    own = D.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("item"))
    return O.fallback_sources([orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), own], "k", "item")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations""")
def section_carry(spark, d):
    rows = D.table(spark, d, "conversations").withColumn("_q", F.when(F.col("role") == "user", F.col("text")))
    return O.carry_forward(rows, ["conv_id"], ["turn"], "_q", "asked").select("conv_id", "turn", "role", "asked")


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
  SELECT doc_id, CASE WHEN 3 * r < n - 1 THEN 'short' WHEN 3 * r < 2 * (n - 1) THEN 'medium' ELSE 'long' END AS third FROM r""")
def length_thirds(spark, d):
    return O.length_thirds(D.table(spark, d, "documents", "doc_id", "n_chars"), F.col("n_chars"), "doc_id").select("doc_id", "third")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def global_row_number(spark, d):
    orders = D.table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return O.global_row_number(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], "place").select("o_orderkey", "place")


_MIX = "((({0} % 2147483647) * 48271 + 11) % 2147483647)"


@query(f"""WITH m AS (SELECT o_orderkey, {_MIX.format('(o_orderkey * 1000003 + 42)')} AS a FROM orders)
  SELECT o_orderkey FROM m ORDER BY (((a * a + 12345) % 2147483647) * 69621) % 2147483647, o_orderkey LIMIT 100""")
def seeded_sample(spark, d):
    orders = D.table(spark, d, "orders", "o_orderkey")
    return O.seeded_sample(orders, 100, O.mixed(F.col("o_orderkey") * 1000003 + 42), "o_orderkey")


@query("""SELECT strftime(d, '%Y-%m') AS month FROM range(DATE '1994-01-01', DATE '2003-01-01', INTERVAL 1 MONTH) t(d)
  WHERE strftime(d, '%Y-%m') NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders)""")
def month_gaps(spark, d):
    found = D.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return M.gaps_by_month(found, "1994-01", "2002-12")


@query("""WITH w AS (SELECT strftime(d, '%Y-%m') AS month FROM range(DATE '1994-01-01', DATE '2003-01-01', INTERVAL 1 MONTH) t(d)),
  f AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, bool_or(day(o_orderdate) = 31) AS pdf FROM orders GROUP BY 1)
  SELECT count(*) AS expected, count(f.month) AS found, count(*) FILTER (WHERE pdf) AS pdf, count(*) FILTER (WHERE NOT pdf) AS page FROM w LEFT JOIN f USING (month)""")
def month_coverage(spark, d):
    """A month with an order on its 31st counts as one with a PDF."""
    found = D.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.dayofmonth("o_orderdate").alias("day"))
    return M.month_coverage(found, "1994-01", "2002-12", F.col("day") == 31)


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
  count(*) FILTER (WHERE o_orderstatus = 'P') AS "P", count(*) AS total FROM orders GROUP BY o_orderpriority""")
def crosstab(spark, d):
    return M.crosstab(D.table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT lang, count(n_chars) AS n, quantile_cont(n_chars, 0.025) AS q2_5, quantile_cont(n_chars, 0.25) AS q25,
  quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.975) AS q97_5 FROM documents GROUP BY lang""")
def quartiles(spark, d):
    return O.quantiles(D.table(spark, d, "documents"), "n_chars", [0.025, 0.25, 0.5, 0.975], ["lang"])


@query("WITH " + D.LABELS + """ SELECT case_no, section, action_date, report_month, summary_rules, doc_rules FROM cases""")
def monthly_with_documents(spark, d):
    rows = D.cases(spark, d)
    docs = rows.select("case_no", "doc_rules")
    return rows.drop("doc_rules").join(docs, "case_no", "left").select(
        "case_no", "section", "action_date", "report_month", "summary_rules", "doc_rules")




@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filtered_scan(spark, d):
    return load_table(spark, f"{d}/orders.parquet", F.col("o_orderstatus").isin("F", "P"), ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def replaced_table(spark, d):
    """A table replaced by a second run and read by partition."""
    orders = D.table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    path = scratch_path(spark, "replaced")
    replace_table(orders.filter("o_orderstatus = 'P'"), path, ["o_orderstatus"])
    replace_table(orders, path, ["o_orderstatus"])
    return load_table(spark, path, F.col("o_orderstatus") == "F", ["o_orderkey", "o_totalprice"])


@query("WITH " + D.CASES + """ SELECT case_no, CASE WHEN doc_rules <> '' THEN doc_rules ELSE summary_rules END AS rules,
  CASE WHEN doc_rules <> '' THEN 'document' WHEN summary_rules <> '' THEN 'summary' END AS label_source FROM cases""")
def labels_without_ocr(spark, d):
    """The OCR table does not exist yet and reads as empty."""
    cases = D.cases(spark, d)
    return L.case_labels(cases, cases, optional_table(spark, scratch_path(spark, "absent"), OCR_LABELS))
