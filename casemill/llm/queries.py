"""The registered queries of this package: name -> (function of (spark, folder), equivalent SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from casemill.llm import (
    licenses, merges, packing, ppm, quality, runs, simhash, subword, threads, unigram, urlrules, vectors, wrappers)
from casemill.sources.session import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % by


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(table(spark, folder, "pages"))


#: The pages of the test tables have one article each, plain block tags and five character references.
OP1_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(h, '</?b>', '', 'g'), '</?(?:h1|p|br)>'),
  lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), ' ') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return urlrules.judge(table(spark, folder, "pages"), rules)


OP2_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM r),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rule_host, rule_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path,
  (SELECT rule_host || rule_path FROM rules WHERE ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path)
   ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS rule FROM u)
SELECT page_id, host, path, rule, coalesce((SELECT action FROM rules WHERE rule_host || rule_path = rule), 'allow') AS verdict FROM m
"""


def op3_ppm(spark: SparkSession, folder: str) -> DataFrame:
    scored = ppm.scores(table(spark, folder, "documents"), remainder(7) != 2)
    return scored.withColumn("held_out", F.coalesce(remainder(7) == 2, F.lit(False)))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.encode(table(spark, folder, "documents"), unigram.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op7_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"), 0.93)


OP7_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = subword.train(docs, table(spark, folder, "labels"), remainder(5) != 0)
    scored = subword.classify(docs, model, corpus_pipeline.THRESHOLD)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of one directory per source and hundred ids, every 25th of them the directory's licence file."""
    shelf = F.concat(F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"))
    name = F.when(F.col("doc_id") % 25 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, folder, "documents").select(F.col("doc_id").alias("file"), F.concat(shelf, name).alias("path"), "text")
    return licenses.scan(files, licenses.templates(spark)).withColumnRenamed("file", "doc_id")


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9+\-]+(?:\.[a-z0-9]+)*')".replace("\\\\", "\\")
_GIVEN = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
OP9_SQL = f"""
WITH given(template, licence, text) AS (VALUES {_GIVEN}),
gt AS (SELECT template, licence, unnest({_TERMS.format('text')}) AS term FROM given),
gc AS (SELECT template, licence, term, count(*) AS tf FROM gt GROUP BY ALL),
gi AS (SELECT term, ln((1 + {len(licenses.TEMPLATES)}) / (1 + count(*))::DOUBLE) + 1 AS idf FROM gc GROUP BY term),
gw AS (SELECT template, licence, term, tf * idf AS w FROM gc JOIN gi USING (term)),
gl AS (SELECT template, sqrt(sum(w * w)) AS length FROM gw GROUP BY template),
files AS (SELECT doc_id, source || '/' || (doc_id // 100) || '/' || CASE WHEN doc_id % 25 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path,
  source || '/' || (doc_id // 100) AS directory, coalesce(text, '') AS text, doc_id % 25 = 0 AS is_licence FROM documents),
o AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)),
  CASE WHEN is_licence THEN [text] ELSE [] END))) AS offer FROM files),
t AS (SELECT doc_id, offer, term, count(*) AS tf FROM (SELECT doc_id, offer, unnest({_TERMS.format('offer')}) AS term FROM o) GROUP BY ALL),
v AS (SELECT doc_id, offer, t.term, tf * coalesce(idf, ln({1 + len(licenses.TEMPLATES)}::DOUBLE) + 1) AS w FROM t LEFT JOIN gi ON t.term = gi.term),
l AS (SELECT doc_id, offer, sqrt(sum(w * w)) AS length FROM v GROUP BY ALL),
d AS (SELECT doc_id, offer, template, licence, sum(v.w * gw.w) AS dot FROM v JOIN gw ON v.term = gw.term GROUP BY ALL),
c AS (SELECT doc_id, licence, round(dot / gl.length / l.length, 6) AS cosine FROM d JOIN l USING (doc_id, offer) JOIN gl USING (template)),
b AS (SELECT doc_id, licence, cosine FROM c WHERE cosine >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence DESC) = 1),
i AS (SELECT directory, licence FROM files JOIN b USING (doc_id) WHERE is_licence QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, licence DESC) = 1)
SELECT doc_id, path, coalesce(b.licence, i.licence) AS licence, b.cosine AS cosine, CASE WHEN b.licence IS NULL THEN i.directory END AS from_path
FROM files LEFT JOIN b USING (doc_id) LEFT JOIN i USING (directory)
WHERE i.directory IS NULL OR i.directory = files.directory
"""


def op10_rules(spark: SparkSession, folder: str) -> DataFrame:
    book = quality.verdicts(quality.ledger(table(spark, folder, "documents")), quality.V1)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality.passes(F.col("failed"), quality.BASE)).alias("base_failed"), "kept", "failed")


OP10_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
s AS (SELECT *, [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)] AS windows FROM w),
c AS (SELECT *, list_sort(windows) AS ordered FROM s),
r AS (SELECT *, list_distinct([ordered[i] for i in range(2, len(ordered) + 1) if ordered[i] = ordered[i - 1]]) AS again FROM c),
p AS (SELECT *, CASE WHEN len(again) = 0 THEN [] ELSE [i for i in range(1, len(windows) + 1) if list_contains(again, windows[i])] END AS places FROM r),
m AS (SELECT doc_id, len(words) AS n_words,
  length(array_to_string(words, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
  len(list_distinct(flatten([[i, i + 1, i + 2] for i in places]))) AS n_repeat_words,
  length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper,
  length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS n_letters FROM p),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
  + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
  + 16 * (2 * word_chars < 5 * n_words OR word_chars > 15 * n_words)::BIGINT
  + 32 * (100 * n_upper > 50 * n_letters)::BIGINT + 64 * (100 * n_letters < 50 * word_chars)::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


def op11_threads(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations that take their first turns from the first of their twenty."""
    own = written(threads.sequences(table(spark, folder, "conversations")))
    first = F.col("conv_id") - F.col("conv_id") % 20
    heads = own.filter("conv_id % 20 = 0").select(
        F.col("conv_id").alias("first"), F.substring("path", 1, 96).alias("head"), F.slice("words", 1, 3).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    rebuilt = own.withColumn("first", first).withColumn("h", h).join(heads, "first", "left").select(
        "conv_id",
        F.concat(F.coalesce(F.substring("head", F.lit(1), 32 * F.col("h")), F.lit("")),
                 F.substring("path", 32 * F.col("h") + 1, F.length("path"))).alias("path"),
        F.concat(F.coalesce(F.slice("head_words", F.lit(1), F.col("h")), F.array().cast("array<int>")),
                 F.slice("words", F.col("h") + 1, F.size("words"))).alias("words"))
    return threads.nodes(rebuilt).drop("digest")


OP11_SQL = r"""
WITH s AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
  ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(d.own[1:h], []), h.own[h + 1:]) AS turns
  FROM h LEFT JOIN s d ON d.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM r)),
g AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0
    ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY path, d),
c AS (SELECT path[1:d - 1] AS path, count(*) AS n_children, min(conv_id) AS smallest FROM g WHERE d > 0 GROUP BY ALL),
k AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (path)),
a AS (SELECT path[1:i] AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(d + 1)) AS i FROM k) GROUP BY ALL)
SELECT k.conv_id, k.d AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children::BIGINT AS n_children, a.n_leaves::BIGINT AS n_leaves,
  a.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN a USING (path) LEFT JOIN g u ON k.d > 0 AND u.path = k.path[1:k.d - 1]
"""


def op12_merges(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = merges.decode(merges.encode(table(spark, folder, "documents"), path), path)
    return back.select("doc_id", F.expr("length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of all documents; every tenth hash makes a document periodic from a word of its own on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.col("text"), F.lit(threads.WORD), F.lit(0))
    planted = table(spark, folder, "documents").select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).select(
        "doc_id", "text", "words", F.size("words").cast("bigint").alias("n"), F.expr("h div 10").alias("g")).select(
        "doc_id", "text", "words", "n", "g", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a")).select(
        "doc_id", "text", "words", "n", "a", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    place = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.get("words", F.when(
        i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    docs = planted.select("doc_id", F.when(F.col("n") > 0, F.array_join(place, " ")).otherwise(F.col("text")).alias("text"))
    found = runs.collapse(docs)
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_main_text": (op1_main_text, OP1_SQL),
    "op2_url_rules": (op2_url_rules, OP2_SQL),
    "op3_ppm": (op3_ppm, None),
    "op4_packing": (op4_packing, None),
    "op5_pieces": (op5_pieces, None),
    "op6_simhash": (op6_simhash, None),
    "op7_vectors": (op7_vectors, OP7_SQL),
    "op8_quality": (op8_quality, None),
    "op9_licences": (op9_licences, OP9_SQL),
    "op10_rules": (op10_rules, OP10_SQL),
    "op11_threads": (op11_threads, OP11_SQL),
    "op12_merges": (op12_merges, None),
    "op13_runs": (op13_runs, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
