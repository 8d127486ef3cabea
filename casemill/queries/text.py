"""Queries over texts built from the given tables, where the SQL knows the answer without reading the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import citations as CT
from casemill.functions import documents as DF
from casemill.functions import reports as RP
from casemill.functions import rules as R
from casemill.functions.arrays import collapse_space, joined, let
from casemill.operators import documents as DO
from casemill.operators import labels as L
from casemill.queries import derived as D
from casemill.sources.session import written

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def _reports(spark, d):
    """A monthly report per order: one case write-up per item, a section heading before items with status O."""
    case_no = F.concat(F.lit("20"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lpad((F.col("_i") + 1).cast("string"), 2, "0"))
    rows = D.ordered_lines(spark, d).select("l_orderkey", F.posexplode("lines").alias("_i", "x"))
    who = F.col("x.l_suppkey").cast("string")
    block = F.concat(
        F.when(F.col("x.l_linestatus") == "O", F.concat(F.lit("Firms Fined "), F.col("x.l_returnflag"), F.lit("\n"))).otherwise(""),
        F.lit("Firm "), who, F.lit(" (CRD #"), who, F.lit(", New York)\n"), F.date_format("x.l_shipdate", "MMMM d, yyyy"),
        F.lit(" – An AWC was issued for "), F.col("x.phrase"), F.lit(" over work-\nshops. (FINRA Case\n#"), case_no, F.lit(")\n")).alias("block")
    blocks = rows.select("l_orderkey", "_i", block).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("_i", "block"))).alias("b"))
    text = F.concat(F.lit("Disciplinary and Other FINRA Actions | March 2031 1\nSearch\n12\n"),
                    F.array_join(F.transform("b", lambda x: x["block"]), ""), F.lit("FINRA Case #2030000000001\n"))
    return blocks.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("report_url"), text.alias("text"))


_CASES = "WITH " + D.PHRASES + """, cases AS (SELECT l_orderkey, place, 'r' || CAST(l_orderkey AS VARCHAR) AS report_url,
    '20' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || lpad(CAST(place AS VARCHAR), 2, '0') AS case_no, phrase, cited, l_shipdate,
    last_value(CASE WHEN l_linestatus = 'O' THEN 'Firms Fined ' || l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section,
    CASE WHEN place = 1 AND l_linestatus <> 'O' THEN 'Search ' ELSE '' END || 'Firm ' || CAST(l_suppkey AS VARCHAR) || ' (CRD #' || CAST(l_suppkey AS VARCHAR) || ', New York) ' ||
      strftime(l_shipdate, '%B %-d, %Y') || ' – An AWC was issued for ' AS intro, 'Firm ' || CAST(l_suppkey AS VARCHAR) AS respondent
  FROM phrased)"""


@query(_CASES + """ SELECT report_url, case_no, CAST(place - 1 AS INTEGER) AS pos, section, respondent, CAST(l_shipdate AS DATE) AS action_date,
  intro || phrase || ' over workshops.' AS text FROM cases""")
def segment_reports(spark, d):
    return DO.segment_reports(_reports(spark, d), ["report_url"])


@query(_CASES + """ SELECT report_url, '2031-03' AS report_month, case_no, section, respondent, CAST(l_shipdate AS DATE) AS action_date,
  intro || phrase || ' over workshops.' AS text, intro || '[RULE] over workshops.' AS masked_text, cited AS summary_rules FROM cases""")
def monthly_cases(spark, d):
    return DO.monthly_cases(DO.with_report_month(_reports(spark, d)))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4
      WHEN 0 THEN 'https://x/files/p.pdf' WHEN 1 THEN 'https://x/Disciplinary%20Actions_' || strftime(o_orderdate, '%B_%Y') || '.pdf'
      WHEN 2 THEN 'https://x/files/2024-10/' || strftime(o_orderdate, '%b') || '_Actions.pdf' ELSE 'https://x/files/2024-03/Decisions.pdf' END AS report_url,
    o_orderdate FROM orders)
  SELECT o_orderkey, report_url, CASE WHEN o_orderkey % 4 IN (0, 1) THEN strftime(o_orderdate, '%Y-%m')
    WHEN o_orderkey % 4 = 2 THEN CASE WHEN month(o_orderdate) > 10 THEN '2023-' ELSE '2024-' END || strftime(o_orderdate, '%m') END AS report_month FROM t""")
def report_months(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    url = (F.when(k == 0, "https://x/files/p.pdf")
           .when(k == 1, F.concat(F.lit("https://x/Disciplinary%20Actions_"), F.date_format(day, "MMMM_yyyy"), F.lit(".pdf")))
           .when(k == 2, F.concat(F.lit("https://x/files/2024-10/"), F.date_format(day, "MMM"), F.lit("_Actions.pdf")))
           .otherwise("https://x/files/2024-03/Decisions.pdf"))
    text = F.when(k == 0, F.concat(F.lit("Actions\n"), F.date_format(day, "MMMM yyyy"))).otherwise("Actions")
    rows = D.table(spark, d, "orders").select("o_orderkey", url.alias("report_url"), text.alias("text"))
    return DO.with_report_month(rows).drop("text")


def _line_texts(spark, d):
    p = F.col("l_partkey")
    return D.spread_table(spark, d, "lineitem", "l_orderkey").select(
        p, F.concat(F.lit("In lot "), p.cast("string"), F.lit(" the firm violated "), D.phrase(p), F.lit(".")).alias("text"))


@query("WITH " + D.PHRASES + """ SELECT l_partkey, cited AS key, CASE l_partkey % 8 WHEN 0 THEN num || '(a)' WHEN 4 THEN split_part(cited, ':', 2) || '(b)'
    ELSE split_part(cited, ':', 2) END AS rule,
  length('In lot ' || CAST(l_partkey AS VARCHAR) || ' the firm violated ') + strpos(phrase, CASE l_partkey % 8 WHEN 0 THEN num || '(a)'
    WHEN 4 THEN split_part(cited, ':', 2) || '(b)' ELSE split_part(cited, ':', 2) END) - 1 AS start FROM phrased""")
def citation_rows(spark, d):
    return DO.citation_rows(_line_texts(spark, d), keep=["l_partkey"]).select("l_partkey", "key", "rule", "start")


@query("""SELECT l_partkey, 'In lot ' || CAST(l_partkey AS VARCHAR) || ' the firm violated [RULE].' AS masked, 0 AS leaks FROM lineitem""")
def masked_texts(spark, d):
    masked = CT.mask_citations(F.col("text"))
    return _line_texts(spark, d).select("l_partkey", masked.alias("masked")).withColumn("leaks", F.size(CT.leaks(F.col("masked"))))


@query("WITH " + D.PHRASES + """ SELECT l_partkey, CASE l_partkey % 8 WHEN 0 THEN 'Rule ' || substr(num, 1, 1) WHEN 1 THEN 'Rule ' || substr(num, 1, 1)
    WHEN 2 THEN 'G-' || CAST(l_partkey % 40 + 1 AS VARCHAR) WHEN 3 THEN 'Rule 1' WHEN 4 THEN 'Section ' || substr(CAST(l_partkey % 30 + 1 AS VARCHAR), 1, 1)
    WHEN 5 THEN 'Section ' || substr(CAST(l_partkey % 30 + 1 AS VARCHAR), 1, 1) WHEN 6 THEN 'Rule 6' ELSE 'Rule ' || substr(num, 1, 1) END AS leaks, count(*) AS n
  FROM phrased GROUP BY ALL""")
def leaks(spark, d):
    texts = _line_texts(spark, d)
    return texts.groupBy("l_partkey", joined(CT.leaks(F.col("text"))).alias("leaks")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT o_orderkey, repeat('x', 90) || ' Rule 3110 ' || o_orderpriority || repeat('y', 100) || ' Rule 3120 ' || repeat('z', 70) AS t FROM orders),
  h AS (SELECT o_orderkey, t, unnest([strpos(t, 'Rule 3'), strpos(t, 'Rule 312')]) AS place, unnest([0, 1]) AS nth FROM t)
  SELECT CAST(o_orderkey AS VARCHAR) AS case_no, 'Rule 3' AS leak, nth, substr(t, greatest(place - 80, 1), 80 + 6 + 80) AS context FROM h""")
def leak_audit(spark, d):
    text = F.concat(F.lit("x" * 90 + " Rule 3110 "), F.col("o_orderpriority"), F.lit("y" * 100 + " Rule 3120 " + "z" * 70))
    rows = D.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("case_no"), text.alias("masked_text"))
    return DO.leak_audit(rows)


@query("""WITH n AS (SELECT l_partkey, CAST(1000 + l_partkey % 900 * 10 AS VARCHAR) AS num FROM lineitem)
  SELECT l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'See FINRA Rule ' || num || ' and 1122 and 2010 or Rule 10b-9'
    ELSE 'See FINRA Rule ' || CASE WHEN length(replace(num, '1', '')) >= 2 THEN num ELSE replace(num, '1', 'l') END || ', now' END AS fixed, count(*) AS n
  FROM n GROUP BY ALL""")
def ocr_repairs(spark, d):
    p = F.col("l_partkey")
    num = D.number(p)
    text = F.when(p % 2 == 0, F.concat(F.lit("See FINRA Rule "), F.substring(num, 1, 3), F.lit(" "), F.substring(num, 4, 1),
                                       F.lit(" and 1122and2010 or Rule lOb-9"))).otherwise(
        F.concat(F.lit("See FINRA Rule "), F.replace(num, F.lit("1"), F.lit("l")), F.lit(", now")))
    rows = D.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return rows.select("l_partkey", CT.fix_ocr_numbers(text).alias("fixed"), "n")


_CHARGED = "WITH " + D.PHRASES + """, firsts AS (SELECT l_orderkey, cited, min(place) AS place FROM phrased WHERE l_returnflag = 'N'
    AND NOT (regexp_full_match(cited, 'FINRA:(9\\d|01)\\d\\d') OR cited IN ('SEC_SECTION:19', 'SEC_SECTION:15A')) GROUP BY l_orderkey, cited),
  doc AS (SELECT l_orderkey, string_agg(cited, '|' ORDER BY place) AS rules FROM firsts GROUP BY l_orderkey)"""


@query(_CHARGED + """ SELECT CAST(l.l_orderkey AS VARCHAR) AS case_no, coalesce(any_value(rules), '') AS rules FROM lineitem l
  LEFT JOIN doc ON l.l_orderkey = doc.l_orderkey GROUP BY l.l_orderkey""")
def document_labels(spark, d):
    return D.documents(spark, d).select("case_no", joined(DF.document_labels(F.col("text"))).alias("rules"))


@query(_CHARGED + """, docs AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, coalesce(rules, '') AS rules FROM orders
    LEFT JOIN doc ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
  ranked AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n_docs, row_number() OVER (PARTITION BY o_custkey ORDER BY rules <> '' DESC,
    CASE WHEN rules <> '' THEN -epoch(day) ELSE epoch(day) END, CASE WHEN rules <> '' THEN o_orderkey ELSE -o_orderkey END) AS r FROM docs)
  SELECT CAST(o_custkey AS VARCHAR) AS case_no, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS doc_url, rules AS doc_rules, CAST(n_docs AS INTEGER) AS n_docs FROM ranked WHERE r = 1""")
def case_document_labels(spark, d):
    docs = D.documents(spark, d).join(D.table(spark, d, "orders"), F.col("case_no") == F.col("o_orderkey").cast("string")).select(
        F.col("o_custkey").cast("string").alias("case_no"), F.lpad(F.col("case_no"), 12, "0").alias("doc_url"),
        F.to_date("o_orderdate").alias("action_date"), "text")
    return DO.case_document_labels(docs)


@query("WITH " + D.PHRASES + """ SELECT CAST(l_orderkey AS VARCHAR) AS case_no, count(*) FILTER (WHERE l_returnflag <> 'R') AS violations,
  count(*) FILTER (WHERE l_returnflag = 'N') AS settled, count(*) AS review, true AS waiver FROM phrased GROUP BY l_orderkey""")
def document_sentences(spark, d):
    # the text, its part before the waiver and the violation sentences are worked out once a document
    def counted(text):
        return let(DF.before_waiver(text), lambda head: let(DF.violation_sentences(head), lambda v: F.struct(
            F.size(v).cast("bigint").alias("violations"), F.size(DF.settled(v)).cast("bigint").alias("settled"),
            F.size(DF.reviewed(head)).cast("bigint").alias("review"), DF.has_waiver(text).alias("waiver"))))
    return D.documents(spark, d).select("case_no", let(collapse_space(F.col("text")), counted).alias("s")).select("case_no", "s.*")


_SENTENCES = """WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\.([0-9])', chr(1) || '\\1', 'g'), '.')) AS piece,
    generate_subscripts(string_split(regexp_replace(text, '\\.([0-9])', chr(1) || '\\1', 'g'), '.'), 1) AS i,
    len(string_split(regexp_replace(text, '\\.([0-9])', chr(1) || '\\1', 'g'), '.')) AS n FROM documents),
  t AS (SELECT doc_id, CASE WHEN i < n THEN length(piece) + 1 WHEN contains(piece, chr(1)) THEN length(piece) - strpos(reverse(piece), chr(1)) + 1 ELSE 0 END AS chars FROM s)"""


@query(_SENTENCES + """ SELECT d.doc_id, count(*) FILTER (WHERE chars > 0) AS sentences, coalesce(sum(chars), 0) AS chars, coalesce(max(chars), 0) AS longest
  FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id""")
def sentence_split(spark, d):
    """The sentence splitter over whole documents: counts and lengths."""
    rows = D.spread_table(spark, d, "documents", "doc_id").select("doc_id", DF.sentences(F.col("text")).alias("s"))
    size = F.transform("s", lambda x: F.length(x))
    total = F.aggregate(size, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("s").alias("sentences"), total.alias("chars"), F.coalesce(F.array_max(size), F.lit(0)).alias("longest"))


@query("WITH " + D.PHRASES + """ SELECT CAST(l_orderkey AS VARCHAR) AS case_no, 'facts and violative conduct' AS start,
  'Smith sold notes in lot ' || CAST(count(*) AS VARCHAR) || '.' || coalesce(string_agg(' Staff reviewed trades under ' || phrase || '.', '' ORDER BY place)
    FILTER (WHERE l_returnflag = 'R'), '') || ' II.' AS facts FROM phrased GROUP BY l_orderkey""")
def facts_sections(spark, d):
    return D.documents(spark, d).select("case_no", DF.facts_section(F.col("text")).alias("f")).select("case_no", "f.start", "f.facts")


@query("WITH " + D.PHRASES + """ SELECT CAST(l_orderkey AS VARCHAR) AS case_no, 'Smith sold notes in lot ' || CAST(count(*) AS VARCHAR) || '.' ||
  repeat(' Staff reviewed trades under [RULE].', CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INTEGER)) || ' II.' AS facts_text FROM phrased GROUP BY l_orderkey""")
def narratives(spark, d):
    extra = F.concat(DF.facts_section(F.col("text"))["facts"], F.lit(" FINRA Rule 3110 requires supervision. See Regulatory Notice 10-22."))
    told = let(extra, lambda t: DF.narrative(CT.mask_citations(t)))
    return D.documents(spark, d).select("case_no", told.alias("facts_text"))


def _funnel_documents(spark, d):
    n = F.col("o_orderkey") % 5
    body = F.concat(F.lit("OVERVIEW A matter. "), F.when(n != 1, "FACTS AND VIOLATIVE CONDUCT ").otherwise(""), F.lit("Smith sold notes. "),
                    F.when(n == 2, "").when(n == 3, F.lit("FINRA Rule 3110 requires a system. " * 12)).otherwise("He kept the money of a customer. " * 12))
    return D.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("case_no"), F.when(n != 0, body).alias("text"))


def _facts_rows(spark, d):
    # written, as the table and the funnel both read the rows, and a filter on them must not repeat the extraction
    return written(DO.facts_rows(D.dataset(spark, d), _funnel_documents(spark, d)))


_FUNNEL = "WITH " + D.DATASET + """, funnel AS (SELECT case_no, split, CAST(case_no AS BIGINT) % 5 AS n FROM dataset)"""


@query(_FUNNEL + """ SELECT CASE n WHEN 0 THEN 'no document' WHEN 1 THEN 'no facts heading' WHEN 4 THEN 'kept' ELSE 'under 300 characters' END AS reason,
  count(*) AS cases, count(*) FILTER (WHERE n IN (3, 4)) AS long_before_filter FROM funnel GROUP BY 1""")
def facts_funnel(spark, d):
    return DO.facts_funnel(_facts_rows(spark, d))


@query(_FUNNEL + """ SELECT case_no, split, 'Smith sold notes.' || repeat(' He kept the money of a customer.', 12) AS facts_text,
  length('Smith sold notes.' || repeat(' He kept the money of a customer.', 12)) AS chars, 'facts and violative conduct' AS start FROM funnel WHERE n = 4""")
def facts_table(spark, d):
    return DO.facts_table(_facts_rows(spark, d))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS case_no, p AS pos, CAST(2 + o_orderkey % 4 AS INTEGER) AS n, p = 0 AS sanction, p <> 0 AS numbered,
    p >= 2 + o_orderkey % 4 - 3 AS near_end
  FROM (SELECT o_orderkey, unnest([0, 1 + o_orderkey % 4]) AS p FROM orders)""")
def leftover_sentences(spark, d):
    filler = F.array_join(F.array_repeat(F.lit("He sold notes."), (F.col("o_orderkey") % 4).cast("int")), " ")
    text = F.concat_ws(" ", F.lit("The sanctions were weighed."), F.nullif(filler, F.lit("")), F.lit("It cites Rule 3110."))
    facts = D.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("case_no"), F.lit("facts").alias("start"), text.alias("facts_text"))
    return DO.leftover_sentences(facts).select("case_no", "pos", "n", "sanction", "numbered", "near_end")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Only a fine of $5,000.' WHEN o_orderkey % 3 = 1 THEN 'it sold ' || o_orderpriority || ' notes. The firm kept no records.'
  ELSE 'The firm lost ' || o_orderpriority || ' files.' END AS query FROM orders""")
def query_texts(spark, d):
    k, what = F.col("o_orderkey") % 3, F.col("o_orderpriority")
    text = (F.when(k == 0, "Only a fine of $5,000.")
            .when(k == 1, F.concat(F.lit("An AWC was issued in which the firm was fined $5,000.  The firm consented to the entry of findings that it sold "), what,
                                   F.lit(" notes. The firm kept no records. The fine is in effect.")))
            .otherwise(F.concat(F.lit("The firm lost "), what, F.lit(" files. (FINRA Case #2021070000001)"))))
    return D.table(spark, d, "orders").select("o_orderkey", DF.query_text(text).alias("query"))


@query("""WITH docs AS (SELECT o_custkey, o_orderkey, o_orderpriority AS doc_type, CASE o_orderkey % 6 WHEN 0 THEN 'not cached' WHEN 1 THEN 'no text' WHEN 2 THEN 'no violation'
      WHEN 3 THEN 'no citation' WHEN 4 THEN 'neither' ELSE 'apart' END AS reason FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE reason WHEN 'apart' THEN 1 WHEN 'no violation' THEN 2 WHEN 'no citation' THEN 3
      WHEN 'neither' THEN 4 WHEN 'no text' THEN 5 ELSE 6 END, lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS r FROM docs)
  SELECT CAST(o_custkey AS VARCHAR) AS case_no, reason, doc_type, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS doc_url FROM r WHERE r = 1""")
def unlabeled_cases(spark, d):
    k = F.col("o_orderkey") % 6
    cites, violates = F.lit("It names FINRA Rule 3110. "), F.lit("The firm violated its duties. ")
    text = F.when(k == 0, None).when(k == 1, "Short scan.").otherwise(F.concat(
        F.lit(D.FILLER * 6), F.when(k.isin(2, 5), cites).otherwise(""), F.when(k.isin(3, 5), violates).otherwise(""), F.lit(D.WAIVER)))
    docs = D.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("case_no"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("doc_url"),
        F.col("o_orderpriority").alias("doc_type"), text.alias("text"))
    return DO.unlabeled_cases(docs)


@query("WITH " + D.PHRASES + """, odd AS (SELECT l_orderkey, place, phrase FROM phrased WHERE l_returnflag = 'N')
  SELECT CAST(l_orderkey AS VARCHAR) AS case_no, count(*) FILTER (WHERE place <= 1000) AS charged,
    least(3, count(*) FILTER (WHERE contains(phrase, '17a-'))) AS evidence FROM odd GROUP BY l_orderkey""")
def label_evidence(spark, d):
    """The first sentences that carry a given number, of each document with a settled violation."""
    # inlined: a filter on the sentences would work them out again
    def told(s):
        return F.when(F.size(s) > 0, F.array(F.struct(
            F.size(s).cast("bigint").alias("charged"), F.size(L.evidence(s, F.array(F.lit("SEC_RULE:17a-")))).cast("bigint").alias("evidence"))))
    text = collapse_space(F.col("text"))
    return D.documents(spark, d).select("case_no", F.inline(let(DF.settlement_sentences(text), told)))


@query("""WITH n AS (SELECT l_partkey, l_linenumber, CAST(1000 + l_partkey % 900 * 10 AS VARCHAR) AS num FROM lineitem)
  SELECT num, l_linenumber, num || '.05' AS page, num AS base, num AS named, CASE WHEN CAST(num AS INTEGER) < 9000 THEN 'conduct rules (0100-8000)'
    ELSE 'Code of Procedure (9000)' END AS part, 'small ring ' || num AS title, count(*) AS n FROM n GROUP BY ALL""")
def rule_numbers(spark, d):
    rows = D.table(spark, d, "lineitem").select(D.number(F.col("l_partkey")).alias("num"), "l_linenumber").groupBy("num", "l_linenumber").agg(F.count("*").alias("n"))
    page = F.concat("num", F.lit(".05"))
    return rows.select("num", "l_linenumber", page.alias("page"), R.base_rule(page).alias("base"),
                       R.rule_number_in(F.concat(F.lit("finra Rule "), "num", F.lit("(b)(2)"))).alias("named"), R.rulebook_part(F.col("num")).alias("part"),
                       R.clean_title(F.concat("num", F.lit(".  Small   Ring "), "num", F.lit("."))).alias("title"), "n")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Alpha beta' || chr(10) || lang ELSE 'workshops' || chr(10) || 'of ' || lang END AS cleaned FROM documents""")
def clean_report_text(spark, d):
    head = F.lit("Disciplinary and Other FINRA Actions | March 2031 1\n")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(head, F.lit("  Alpha beta \n\n 12 \n"), F.col("lang"), F.lit("  "))).otherwise(
        F.concat(F.lit("work-\nshops\n \t\n"), head, F.lit("7\nof "), F.col("lang")))
    return D.table(spark, d, "documents", "doc_id", "lang").select("doc_id", RP.clean_report_text(text).alias("cleaned"))
