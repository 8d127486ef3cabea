"""Rulebook pages to indexed chunks, and the link graph of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import rulebook as B
from casemill.functions import web
from casemill.functions.arrays import let
from casemill.operators.ordering import global_row_number, keep_first
from casemill.sources.session import written
from casemill.sources.tables import tasks


def page_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of the indexable pages, keyed by (page_order, part). Narrow: no shuffle."""
    kept = pages.filter(B.may_be_indexed(F.col("rule_no")))
    # a filter on the body or its words would make Spark work them out again, also the one on the size that it puts below a
    # plain posexplode: a page too short has no windows
    windows = let(B.rule_body(F.col("text"), F.coalesce("title", F.lit(""))), B.indexed_windows)
    return kept.select("page_order", F.upper("rule_no").alias("rule_no"), "title", "url",
                       F.posexplode_outer(windows).alias("part", "text")).filter(F.col("part").isNotNull())


def numbered_chunks(pages: DataFrame) -> DataFrame:
    """Chunks with a running ``chunk_id`` in page order."""
    # written: the ranges are drawn from a sample, which would work all chunks out once more
    rows = global_row_number(written(page_chunks(pages)), [F.col("page_order"), F.col("part")], "_n")
    return rows.withColumn("chunk_id", F.col("_n") - 1).drop("_n")


def unindexed_pages(pages: DataFrame) -> DataFrame:
    """Pages whose rule has no chunk, with what their text says."""
    kept = page_chunks(pages).select(F.col("rule_no").alias("_rule")).distinct()
    return pages.withColumn("_rule", F.upper("rule_no")).join(kept, "_rule", "left_anti").select(
        "rule_no", "title", B.rule_body(F.col("text"), F.coalesce("title", F.lit(""))).alias("body"))


def index_summary(chunks: DataFrame) -> DataFrame:
    """Chunks, rules, and the median words per chunk."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("rule_no").alias("rules"),
                      F.percentile(F.size(B.words(F.col("text"))), F.lit(0.5)).alias("median_words"))


def link_rows(pages: DataFrame) -> DataFrame:
    """Distinct absolute links of each page in first-seen order. Narrow: no shuffle."""
    found = F.array_distinct(F.transform(web.links(F.col("html"), F.col("url")), lambda u: F.substring_index(u, "#", 1)))
    return pages.select("page_id", F.posexplode(found).alias("pos", "link"))


def report_link_rows(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(web.report_links(F.col("html"), F.col("url"))).alias("pos", "link"))


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", web.page_title(F.col("html")).alias("title"),
                        web.main_text(F.col("html")).alias("text"))


def rule_pages(pages: DataFrame) -> DataFrame:
    """Parsed rule pages; a rule read under two addresses keeps the first."""
    rows = pages.select("page_id", web.rule_no_of(F.col("url")).alias("rule_no"),
                        web.page_title(F.col("html")).alias("title"), F.col("url"),
                        web.main_text(F.col("html")).alias("text")).filter("rule_no is not null")
    return keep_first(rows, ["rule_no"], ["page_id"])


def listing_rows(pages: DataFrame) -> DataFrame:
    """Document rows of listing pages; a document listed twice keeps its first row."""
    rows = pages.select("page_id", "url", F.posexplode(web.table_rows(F.col("html"))).alias("pos", "tr"))
    # inlined, so a row is read once: a filter on the parsed row would read it again. Rows are dealt to tasks by their page and
    # place, as a few small pages or one long list would otherwise be few tasks' work
    dealt = rows.repartition(tasks(rows), "page_id", "pos")
    parsed = dealt.select("page_id", "pos", F.array(web.listing_row(F.col("tr"), F.col("url"))).alias("d"))
    parsed = parsed.select("page_id", "pos", F.inline(F.filter("d", lambda x: x.isNotNull())))
    return keep_first(parsed, ["doc_url"], ["page_id", "pos"]).drop("page_id", "pos")
