"""Queries over chunks and rankings: documents as the rulebook, benchmark items as the searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.constants import STOP_WORDS
from casemill.functions import rulebook as RB
from casemill.functions.arrays import words
from casemill.operators import bm25, chunks as CH, documents as DO, fusion as FU, ordering as O
from casemill.operators.dense import nearest
from casemill.operators.documents import titles_in_text
from casemill.queries import derived as D
from casemill.sources.session import written

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


_STOP = "', '".join(STOP_WORDS)
_WS = "[\\s\\x0B\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _tokens(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.-][a-z0-9]+)*'), lambda t: t NOT IN ('{_STOP}'))")


def _index_sql(docs: str) -> str:
    """``docs`` is a query of (id, text)."""
    return f"""docs AS ({docs}), tok AS (SELECT id, {_tokens('text')} AS ts FROM docs),
  tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM tok) GROUP BY id, term),
  size AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tok),
  idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, size GROUP BY term),
  weights AS (SELECT tf.term, tf.id, tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(tok.ts) / size.mean)) * idf.idf AS weight
    FROM tf JOIN idf ON tf.term = idf.term JOIN tok ON tf.id = tok.id, size)"""


def _search_sql(docs: str, queries: str = "SELECT item_id AS q, text FROM benchmark") -> str:
    return "WITH " + _index_sql(docs) + f""", qs AS ({queries}), qt AS (SELECT DISTINCT q, unnest({_tokens('text')}) AS term FROM qs),
  scores AS (SELECT qt.q, weights.id, round(sum(weight), 9) AS score FROM qt JOIN weights ON qt.term = weights.term GROUP BY qt.q, weights.id)"""


_DOCS = "SELECT doc_id AS id, text FROM documents"


@query("WITH " + _index_sql(_DOCS) + " SELECT id AS doc_id, term, round(weight, 6) AS weight FROM weights")
def bm25_index(spark, d):
    docs = D.spread_table(spark, d, "documents", "doc_id").select("doc_id", "text")
    return bm25.build_index(docs, "doc_id", F.col("text")).weights().select("doc_id", "term", D.r6("weight").alias("weight"))


@query(_search_sql(_DOCS) + """ SELECT q AS item_id, id AS doc_id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY q ORDER BY score DESC, id) AS r FROM scores) WHERE r <= 5""")
def bm25_topk(spark, d):
    docs = D.spread_table(spark, d, "documents", "doc_id").select("doc_id", "text")
    queries = D.table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    top = bm25.search_top(docs, "doc_id", F.col("text"), queries, "item_id", F.col("q"), 5)
    return top.withColumn("score", D.r6("score"))


_TITLED = "SELECT doc_id AS id, concat_ws(' ', source, lang, text) AS text FROM documents"


@query(_search_sql(_TITLED, "SELECT doc_id AS q, source || ' ' || lang || ' ' || left(text, 40) AS text FROM documents WHERE doc_id % 20 = 0") + """
  SELECT q AS query_id, id AS doc_id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY q ORDER BY score DESC, id) AS r FROM scores) WHERE r <= 5""")
def bm25_titled_topk(spark, d):
    """Title and text are one searched text; every twentieth document asks with its title and first words."""
    docs = D.spread_table(spark, d, "documents", "doc_id").select("doc_id", "source", "lang", "text")
    titled = docs.select("doc_id", F.concat_ws(" ", "source", "lang", "text").alias("text"))
    queries = docs.filter("doc_id % 20 = 0").select(
        F.col("doc_id").alias("query_id"), F.concat("source", F.lit(" "), "lang", F.lit(" "), F.substring("text", 1, 40)).alias("q"))
    top = bm25.search_top(titled, "doc_id", F.col("text"), queries, "query_id", F.col("q"), 5)
    return top.withColumn("score", D.r6("score"))


def _rule_pages(spark, d):
    """Documents as rulebook pages."""
    rule = (1000 + F.col("doc_id") % 9000).cast("string")
    title = F.concat(rule, F.lit(". "), F.col("source"))
    text = F.concat(F.lit("Menu Home "), title, F.lit(" The Rule Notices "), F.col("text"), F.lit(" Amended by SR-1 Rulebook Search © x"))
    return D.spread_table(spark, d, "documents", "doc_id").select(
        F.col("doc_id").alias("page_order"), rule.alias("rule_no"), title.alias("title"), F.lit("u").alias("url"), text.alias("text"), "doc_id")


_PAGES = f"""pages_ AS (SELECT doc_id, CAST(1000 + doc_id % 9000 AS VARCHAR) AS rule_no, CAST(1000 + doc_id % 9000 AS VARCHAR) || '. ' || source AS title,
    trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS t FROM documents),
  footers AS (SELECT *, least(CASE WHEN strpos(t, 'Rulebook Search') > 0 THEN strpos(t, 'Rulebook Search') ELSE 1000000 END,
    CASE WHEN strpos(t, 'Related Topics') > 0 THEN strpos(t, 'Related Topics') ELSE 1000000 END,
    CASE WHEN strpos(t, 'Sign Up for Newsletters') > 0 THEN strpos(t, 'Sign Up for Newsletters') ELSE 1000000 END,
    CASE WHEN strpos(t, '©') > 0 THEN strpos(t, '©') ELSE 1000000 END) AS cut FROM pages_),
  bodies AS (SELECT doc_id, rule_no, title, trim(substr(t, 1, cut - 1)) AS body,
    list_filter(regexp_split_to_array(trim(substr(t, 1, cut - 1)), '{_WS}'), lambda x: x <> '') AS w FROM footers),
  indexed AS (SELECT * FROM bodies WHERE len(w) >= 8 AND NOT regexp_full_match(rule_no, '0100|\\d000')),
  parts AS (SELECT doc_id, rule_no, title, body, w, unnest(CASE WHEN len(w) <= 250 THEN [0] ELSE range(0, greatest(1, len(w) - 40), 210) END) AS off FROM indexed),
  chunks AS (SELECT row_number() OVER (ORDER BY doc_id, off) - 1 AS chunk_id, doc_id, rule_no, title, CAST(off // 210 AS INTEGER) AS part,
    CASE WHEN len(w) <= 250 THEN body ELSE array_to_string(w[off + 1 : off + 250], ' ') END AS text FROM parts)"""


@query("WITH " + _PAGES + " SELECT chunk_id, rule_no, title, part, text FROM chunks")
def chunks(spark, d):
    return CH.numbered_chunks(_rule_pages(spark, d)).select("chunk_id", "rule_no", "title", "part", "text")


@query("WITH " + _PAGES + " SELECT rule_no, title, body FROM bodies WHERE rule_no NOT IN (SELECT rule_no FROM indexed)")
def unindexed_pages(spark, d):
    return CH.unindexed_pages(_rule_pages(spark, d))


@query("WITH " + _PAGES + f""" SELECT count(*) AS chunks, count(DISTINCT rule_no) AS rules,
  quantile_cont(len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '')), 0.5) AS median_words FROM chunks""")
def index_summary(spark, d):
    return CH.index_summary(CH.page_chunks(_rule_pages(spark, d)))


@query("""SELECT doc_id, CASE WHEN n <= 250 THEN 1 ELSE len(range(0, greatest(1, n - 40), 210)) END AS windows, n AS words FROM
  (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '""" + _WS + """'), lambda x: x <> '')) AS n FROM documents)""")
def word_windows(spark, d):
    return D.spread_table(spark, d, "documents", "doc_id").select(
        "doc_id", F.size(RB.word_windows(F.col("text"))).alias("windows"), F.size(words(F.col("text"))).alias("words"))


# --- rankings over all documents and all vectors ------------------------------------------------------------




def _book(spark, d, *columns):
    """Every document that has a vector as a chunk of a rule, with the vectors dealt out in turn; a rule above 9000 is no conduct rule."""
    vectors = D.table(spark, d, "embeddings", "vec_id", "embedding")
    rule = F.concat((1000 + F.col("doc_id") % 400 * 21).cast("string"), F.lit(".01"))
    return D.table(spark, d, "documents", "doc_id", "text").withColumn("vec_id", F.col("doc_id") % vectors.agg(F.count("*")).scalar()).join(
        vectors, "vec_id").select("doc_id", rule.alias("rule_no"), *columns)


def _vector_chunks(spark, d):
    rows = O.global_row_number(_book(spark, d, "text", "embedding"), [F.col("doc_id")], "_n")
    return written(rows.select((F.col("_n") - 1).alias("chunk_id"), "rule_no", F.lit("t").alias("title"), "text", "embedding"))


def _searches(spark, d):
    """Benchmark items with the vector of the same number."""
    return written(D.table(spark, d, "benchmark").join(D.table(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select(
        "item_id", F.col("text").alias("q"), "embedding", "label"))


_VEC = """vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  units AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vecs),
  vchunks AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS chunk_id, doc_id, CAST(1000 + doc_id % 400 * 21 AS VARCHAR) AS rule, 1000 + doc_id % 400 * 21 < 9000 AS conduct, text, v
    FROM documents JOIN units ON doc_id % (SELECT count(*) FROM embeddings) = vec_id),
  searches AS (SELECT item_id, text, v, label FROM benchmark JOIN units ON item_id = vec_id),
  dense AS (SELECT s.item_id, c.chunk_id, round(list_dot_product(s.v, c.v), 9) AS score FROM searches s CROSS JOIN vchunks c)"""
_BOTH = _search_sql("SELECT chunk_id AS id, text FROM vchunks", "SELECT item_id AS q, text FROM searches").replace("WITH ", "WITH " + _VEC + ", ", 1) + """,
  full_words AS (SELECT d.item_id, d.chunk_id, coalesce(s.score, 0) AS ws, d.score AS ds FROM dense d LEFT JOIN scores s ON s.q = d.item_id AND s.id = d.chunk_id),
  ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ws DESC, chunk_id) AS w, row_number() OVER (PARTITION BY item_id ORDER BY ds DESC, chunk_id) AS dr FROM full_words),
  fused AS (SELECT item_id, chunk_id, ws, ds, round(1 / (60 + w) + 1 / (60 + dr), 15) AS hs FROM ranks),
  three AS (SELECT 'bm25' AS retriever, item_id, chunk_id, ws AS score FROM fused UNION ALL SELECT 'dense', item_id, chunk_id, ds FROM fused
    UNION ALL SELECT 'hybrid', item_id, chunk_id, hs FROM fused),
  best AS (SELECT t.*, c.rule, row_number() OVER (PARTITION BY retriever, item_id, c.rule ORDER BY score DESC, t.chunk_id) AS b FROM three t JOIN vchunks c ON t.chunk_id = c.chunk_id WHERE c.conduct),
  ranked AS (SELECT retriever, item_id, chunk_id, rule, score, row_number() OVER (PARTITION BY retriever, item_id ORDER BY score DESC, chunk_id) AS rank FROM best WHERE b = 1),
  top5 AS (SELECT * FROM ranked WHERE rank <= 5)"""


@query("WITH " + _VEC + """, every AS (SELECT s.item_id, u.vec_id AS chunk_id, round(list_dot_product(s.v, u.v), 9) AS score FROM searches s CROSS JOIN units u)
  SELECT item_id, chunk_id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id
  ORDER BY score DESC, chunk_id) AS r FROM every) WHERE r <= 5""")
def dense_topk(spark, d):
    """The five nearest of all vectors for each search."""
    vectors = D.table(spark, d, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "chunk_id")
    return nearest(vectors, _searches(spark, d), "chunk_id", "item_id").withColumn("score", D.r6("score"))


def _scores(book, searches):
    index = bm25.build_index(book.select("chunk_id", "text"), "chunk_id", F.col("text"), bm25.query_terms(searches, "item_id", F.col("q")))
    return written(index.scores(searches, "item_id", F.col("q")))


def _ranked(spark, d):
    book, searches = _vector_chunks(spark, d), _searches(spark, d)
    scores = _scores(book, searches)
    wanted = ["item_id", "chunk_id", "rule", "score", "rank"]
    lists = {"bm25": FU.top_rules(scores, book, searches, "item_id", conduct_only=True),
             "dense": FU.dense_rules(book, searches, "item_id", conduct_only=True),
             "hybrid": FU.hybrid_rules(scores, book, searches, "item_id", conduct_only=True)}
    rows = [df.select(F.lit(name).alias("retriever"), *wanted) for name, df in lists.items()]
    return written(rows[0].unionByName(rows[1]).unionByName(rows[2])), book, searches


@query(_BOTH + " SELECT retriever, item_id, chunk_id, rule, round(score, 6) AS score, rank FROM top5")
def ranked_rules(spark, d):
    return _ranked(spark, d)[0].withColumn("score", D.r6("score"))


_GOLD = _BOTH + """, gold AS (SELECT item_id, [CAST(1000 + item_id % 400 * 21 AS VARCHAR), CAST(1000 + (item_id * 7 + 3) % 400 * 21 AS VARCHAR)] AS gold FROM searches WHERE label <> 9),
  hits AS (SELECT t.retriever, t.item_id, min(CASE WHEN list_contains(gold, rule) THEN rank END) AS first FROM top5 t JOIN gold g ON t.item_id = g.item_id GROUP BY 1, 2)"""


def _gold(searches):
    i = F.col("item_id")
    rule = lambda n: (1000 + n % 400 * 21).cast("string")
    return searches.select("item_id", F.when(F.col("label") != 9, F.array(rule(i), rule(i * 7 + 3))).otherwise(F.array().cast("array<string>")).alias("gold"))


def _hits(spark, d):
    ranked, _, searches = _ranked(spark, d)
    gold = _gold(searches)
    return written(FU.retrieval_hits(ranked, gold, "item_id")), gold, searches


@query(_GOLD + """ SELECT retriever, count(*) AS cases, round(avg(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END), 6) AS hit_rate,
  round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM hits GROUP BY retriever""")
def retrieval_report(spark, d):
    rates = FU.hit_rates(_hits(spark, d)[0])
    return rates.withColumn("hit_rate", D.r6("hit_rate")).withColumn("mrr", D.r6("mrr"))


@query(_GOLD + f""", scored AS (SELECT DISTINCT s.item_id, len(list_filter(regexp_split_to_array(s.text, '{_WS}'), lambda x: x <> '')) AS w FROM searches s JOIN hits h ON s.item_id = h.item_id),
  r AS (SELECT item_id, row_number() OVER (ORDER BY w, item_id) - 1 AS r, count(*) OVER () AS n FROM scored),
  thirds AS (SELECT item_id, CASE WHEN 3 * r < n - 1 THEN 'short' WHEN 3 * r < 2 * (n - 1) THEN 'medium' ELSE 'long' END AS third FROM r)
  SELECT retriever, third, count(*) AS cases, round(avg(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM hits h JOIN thirds t ON h.item_id = t.item_id GROUP BY 1, 2""")
def hits_by_length(spark, d):
    hits, _, searches = _hits(spark, d)
    return FU.hits_by_length(hits, searches, "item_id", "q").select("retriever", "third", "cases", D.r6("hit_rate").alias("hit_rate"), D.r6("mrr").alias("mrr"))


@query(_GOLD + """, s AS (SELECT DISTINCT item_id, 'FINRA:' || CAST(CAST(g AS INTEGER) // 1000 * 1000 AS VARCHAR) AS series FROM (SELECT item_id, unnest(gold) AS g FROM gold))
  SELECT retriever, series, count(*) AS cases, round(avg(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM hits h JOIN s ON h.item_id = s.item_id GROUP BY 1, 2""")
def hits_by_series(spark, d):
    hits, gold, _ = _hits(spark, d)
    return FU.hits_by_series(hits, gold, "item_id").select("retriever", "series", "cases", D.r6("hit_rate").alias("hit_rate"), D.r6("mrr").alias("mrr"))


@query(_GOLD + """, slots AS (SELECT t.retriever, CASE WHEN CAST(rule AS INTEGER) < 9000 THEN 'conduct rules (0100-8000)' ELSE 'Code of Procedure (9000)' END AS part
    FROM top5 t JOIN gold g ON t.item_id = g.item_id)
  SELECT retriever, part, count(*) AS n, 1.0 AS share FROM slots GROUP BY 1, 2""")
def slots_by_part(spark, d):
    return FU.slots_by_part(_hits(spark, d)[0])


@query(_GOLD + """, n AS (SELECT t.retriever, rule, count(*) AS cases FROM top5 t JOIN gold g ON t.item_id = g.item_id GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY retriever ORDER BY cases DESC, rule) AS rank FROM n)
  SELECT retriever, rank, rule, cases, round(cases / (SELECT count(*) FROM gold), 6) AS share FROM r WHERE rank <= 10""")
def most_listed(spark, d):
    return FU.most_listed(_hits(spark, d)[0]).withColumn("share", D.r6("share"))


@query(_GOLD + """ SELECT item_id, len(list_filter(gold, lambda g: g IN (SELECT rule FROM vchunks))) > 0 AS gold_in_book FROM gold""".replace(
    "len(list_filter(gold, lambda g: g IN (SELECT rule FROM vchunks))) > 0", "gold[1] IN (SELECT rule FROM vchunks) OR gold[2] IN (SELECT rule FROM vchunks)"))
def gold_in_book(spark, d):
    """No ranking is needed, only the searches and the rules of the chunks."""
    return FU.gold_in_book(_gold(_searches(spark, d)), _book(spark, d), "item_id")


@query(_GOLD + """, p AS (SELECT CASE WHEN CAST(g AS INTEGER) < 9000 THEN 'conduct rules (0100-8000)' ELSE 'Code of Procedure (9000)' END AS part FROM (SELECT unnest(gold) AS g FROM gold))
  SELECT part, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY part""")
def gold_by_part(spark, d):
    return FU.gold_by_part(_gold(_searches(spark, d))).withColumn("share", D.r6("share"))


@query(_BOTH + """ SELECT item_id, string_agg('[' || CAST(rank AS VARCHAR) || '] Rule ' || t.rule || '.01: t' || chr(10) || c.text, chr(10) || chr(10) ORDER BY rank) AS excerpts
  FROM top5 t JOIN vchunks c ON t.chunk_id = c.chunk_id WHERE retriever = 'bm25' GROUP BY item_id""")
def excerpt_texts(spark, d):
    """Only the ranking by words is quoted, so only that is worked out."""
    book, searches = _vector_chunks(spark, d), _searches(spark, d)
    ranked = FU.top_rules(_scores(book, searches), book, searches, "item_id", conduct_only=True)
    return FU.excerpts(ranked, book, "item_id")


# --- rule titles in texts ------------------------------------------------------------------------------------

@query("""SELECT doc_id, title FROM documents d, (SELECT DISTINCT lower(text) AS title FROM benchmark) t WHERE contains(lower(d.text), title)""")
def titles_in_texts(spark, d):
    texts = D.spread_table(spark, d, "documents", "doc_id").select("doc_id", F.lower("text").alias("t"))
    titles = D.table(spark, d, "benchmark").select(F.lower("text").alias("title"))
    return titles_in_text(texts, titles, "t", "title", ["doc_id"])


@query("""SELECT doc_id, title FROM documents d, (SELECT DISTINCT lower(text) AS title FROM benchmark) t WHERE length(title) >= 12 AND contains(lower(d.text), title)""")
def title_leaks(spark, d):
    texts = D.spread_table(spark, d, "documents", "doc_id").select("doc_id", "text")
    return DO.title_leaks(texts, D.table(spark, d, "benchmark").select(F.col("text").alias("title")), "text", "title", ["doc_id"])


def _titled(spark, d):
    """Cases whose text names their parts, and a rulebook with part names as titles."""
    parts = D.table(spark, d, "part")
    rule = D.number(F.col("p_partkey"))
    pages = parts.select(F.when(F.col("p_partkey") < 900, rule).otherwise(F.concat(rule, F.lit(".05"))).alias("rule_no"),
                         F.concat(rule, F.lit(". "), F.col("p_name"), F.lit(".")).alias("title"), "p_partkey")
    pages = pages.groupBy("rule_no").agg(F.min_by("title", "p_partkey").alias("title"))
    items = D.lines(spark, d).join(parts, F.col("l_partkey") == F.col("p_partkey")).join(D.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    texts = items.groupBy("o_orderkey", "o_orderdate").agg(
        F.array_join(F.sort_array(F.collect_set("key")), "|").alias("rules"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("p_name")))), " of ").alias("masked_text"))
    split = F.when(F.year("o_orderdate") >= 2000, "test").otherwise("train")
    return texts.select(F.col("o_orderkey").cast("string").alias("case_no"), split.alias("split"), F.upper("masked_text").alias("masked_text"), "rules"), pages


_TITLES = "WITH " + D.LINES + ", " + D.SUCCESSORS + f""", titles AS (SELECT CAST(1000 + p_partkey % 900 * 10 AS VARCHAR) AS rule, lower(arg_min(p_name, p_partkey)) AS title FROM part GROUP BY 1),
  cases AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_no, coalesce(array_to_string(list_sort(list(DISTINCT p_name) FILTER (WHERE l_quantity > 25)), ' of '), '') AS text,
      list(DISTINCT key) AS keys FROM lines JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) >= 2000 GROUP BY o_orderkey),
  gold AS (SELECT DISTINCT case_no, text, split_part(k, ':', 2) AS rule FROM (SELECT case_no, text, coalesce(new, key) AS k FROM (SELECT case_no, text, unnest(keys) AS key FROM cases)
      LEFT JOIN succ ON key = old) WHERE k LIKE 'FINRA:%' AND NOT {D.not_charged('k')}),
  charged AS (SELECT case_no, gold.rule, title, contains(lower(text), title) AS hit FROM gold JOIN titles ON gold.rule = titles.rule)"""


@query(_TITLES + " SELECT count(*) AS scored, round(avg(CASE WHEN h THEN 1 ELSE 0 END), 6) AS share FROM (SELECT bool_or(hit) AS h FROM charged GROUP BY case_no)")
def title_share(spark, d):
    return DO.title_share(*_titled(spark, d))[0].withColumn("share", D.r6("share"))


@query(_TITLES + """, c AS (SELECT case_no, bool_or(hit) AS h FROM charged GROUP BY case_no),
  s AS (SELECT DISTINCT case_no, 'FINRA:' || CAST(CAST(rule AS INTEGER) // 1000 * 1000 AS VARCHAR) AS series FROM charged)
  SELECT series, count(*) AS cases, round(avg(CASE WHEN h THEN 1 ELSE 0 END), 6) AS with_title FROM s JOIN c ON s.case_no = c.case_no GROUP BY series""")
def title_share_by_series(spark, d):
    return DO.title_share(*_titled(spark, d))[1].withColumn("with_title", D.r6("with_title"))


@query(_TITLES + """, r AS (SELECT rule, title, count(*) AS charged_cases, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS ch FROM charged GROUP BY rule, title HAVING count(*) >= 5),
  f AS (SELECT title, count(*) AS hits FROM (SELECT DISTINCT title FROM r) t JOIN cases ON contains(lower(text), title) GROUP BY title)
  SELECT rule, r.title, charged_cases, round(ch / charged_cases, 6) AS charged, round((coalesce(hits, 0) - ch) / ((SELECT count(*) FROM cases) - charged_cases), 6) AS not_charged
  FROM r LEFT JOIN f ON r.title = f.title""")
def title_share_by_rule(spark, d):
    got = DO.title_share(*_titled(spark, d))[2]
    return got.withColumn("charged", D.r6("charged")).withColumn("not_charged", D.r6("not_charged"))


