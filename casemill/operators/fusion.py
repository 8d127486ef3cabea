"""Ranked rule lists: best chunk per rule, reciprocal rank fusion, and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.functions import rules as R
from casemill.functions.arrays import words
from casemill.operators import dense
from casemill.operators.metrics import value_shares
from casemill.operators.ordering import best_per_key, global_row_number, length_thirds
from casemill.sources.session import written


def searchable(chunks: DataFrame, conduct_only: bool) -> DataFrame:
    return chunks.filter(R.is_conduct_rule(F.col("rule_no"))) if conduct_only else chunks


def _top_rules(scored: DataFrame, query_id: str, k: int) -> DataFrame:
    by_score = [F.col("score").desc(), F.col("chunk_id").asc()]
    best = best_per_key(scored, [query_id, "rule"], by_score)
    return best_per_key(best, [query_id], by_score, k, rank="rank")


def top_rules(scores: DataFrame, chunks: DataFrame, queries: DataFrame, query_id: str, k: int = C.TOP_K,
              conduct_only: bool = False) -> DataFrame:
    """The k best rules per query, each by its best chunk; ties by chunk_id.

    ``scores`` holds positive scores only. A query that matches fewer than k rules is filled with unmatched
    rules in chunk order at score 0: of the first 2k rules in that order at most k can be matched.
    """
    book = searchable(chunks, conduct_only).select("chunk_id", R.base_rule(F.col("rule_no")).alias("rule"))
    top = _top_rules(scores.join(book, "chunk_id"), query_id, k).select(query_id, "chunk_id", "rule", "score", "rank")
    first = book.groupBy("rule").agg(F.min("chunk_id").alias("chunk_id")).orderBy("chunk_id").limit(2 * k)
    pad = first.agg(F.sort_array(F.collect_list(F.struct("chunk_id", "rule")))).scalar()
    have = top.groupBy(query_id).agg(F.collect_set("rule").alias("_rules"))
    short = queries.select(query_id).join(have, query_id, "left").withColumn(
        "_rules", F.coalesce("_rules", F.array().cast("array<string>"))).filter(F.size("_rules") < k)
    left = F.filter("_pad", lambda p: ~F.array_contains(F.col("_rules"), p["rule"]))
    filled = short.withColumn("_pad", pad).select(query_id, F.size("_rules").alias("_n"), F.posexplode(
        F.slice(left, F.lit(1), k - F.size("_rules"))).alias("_pos", "p")).select(
        query_id, "p.chunk_id", "p.rule", F.lit(0.0).alias("score"), (F.col("_n") + F.col("_pos") + 1).alias("rank"))
    return top.unionByName(filled)


def dense_rules(chunks: DataFrame, queries: DataFrame, query_id: str, k: int = C.TOP_K,
                conduct_only: bool = False) -> DataFrame:
    """The k best rules per query by vector similarity."""
    book = searchable(chunks, conduct_only).withColumn("rule", R.base_rule(F.col("rule_no")))
    return dense.nearest(book, queries, "chunk_id", query_id, k, group="rule")


def _bm25_ranks(scores: DataFrame, candidates: DataFrame, query_id: str) -> DataFrame:
    """Exact BM25 rank of each candidate over all chunks, chunks without a match last in chunk order.

    The scores are numbered by one range-partitioned sort and the candidates read their numbers, so a score row is compared
    with its neighbours in the order, not with every candidate, however deep the candidates reach.
    """
    matched = _numbered(scores, query_id, [F.col("score").desc(), F.col("chunk_id")], "rank").join(candidates, [query_id, "chunk_id"], "left_semi")
    # an unmatched chunk follows all matched ones and the unmatched ones before it
    unmatched = written(candidates.join(scores, [query_id, "chunk_id"], "left_anti").select(query_id, "chunk_id"))
    some = unmatched.select(query_id).distinct()
    own = scores.join(some, query_id, "left_semi")
    both = own.select(query_id, "chunk_id", F.lit(False).alias("_asked")).unionByName(unmatched.withColumn("_asked", F.lit(True)))
    asked = _numbered(both, query_id, [F.col("chunk_id")], "_place").filter("_asked")
    # candidates per query are bounded
    nth = F.row_number().over(W.partitionBy(query_id).orderBy("chunk_id"))
    counts = own.groupBy(query_id).agg(F.count("*").alias("_all"))
    last = asked.withColumn("_before", F.col("_place") - nth).join(counts, query_id, "left").select(
        query_id, "chunk_id", (F.coalesce("_all", F.lit(0)) + F.col("chunk_id") - F.col("_before") + 1).alias("rank"))
    return matched.select(query_id, "chunk_id", "rank").unionByName(last)


def _numbered(rows: DataFrame, query_id: str, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in each query. One range-partitioned sort over all queries, so a query is never one task."""
    numbered = global_row_number(rows, [F.col(query_id), *order], "_n")
    first = numbered.groupBy(query_id).agg(F.min("_n").alias("_first"))
    return numbered.join(first, query_id).withColumn(name, F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def _whole_ranks(scores: DataFrame, chunks: DataFrame, queries: DataFrame, query_id: str) -> DataFrame:
    """(query_id, chunk_id, w, d): both ranks of every chunk.

    One range-partitioned sort over all queries numbers the rows, so a query's whole ranking is never one task.
    """
    pairs = dense.all_scores(chunks, queries, "chunk_id", query_id).withColumnRenamed("score", "ds")
    words_too = pairs.join(scores.withColumnRenamed("score", "ws"), [query_id, "chunk_id"], "left").fillna(0.0, ["ws"])
    both = written(words_too.select(query_id, "chunk_id", "ds", "ws"))

    def ranked(score: str, name: str) -> DataFrame:
        return _numbered(both.select(query_id, "chunk_id", score), query_id, [F.col(score).desc(), F.col("chunk_id")], name).drop(score)
    return ranked("ws", "w").join(ranked("ds", "d"), [query_id, "chunk_id"])


def hybrid_rules(scores: DataFrame, chunks: DataFrame, queries: DataFrame, query_id: str, k: int = C.TOP_K,
                 conduct_only: bool = False, rrf_k: int = C.RRF_K, max_depth: int = 1000) -> DataFrame:
    """The k best rules per query by 1/(rrf_k + BM25 rank) + 1/(rrf_k + dense rank) over the full rankings.

    Only chunks near the top of one ranking can win. If the k-th rule of the dense list stands at rank R, k
    rules score at least 1/(rrf_k + R), while a chunk beyond depth rrf_k + 2R in both rankings scores less. So
    the chunks within that depth of either ranking are the candidates, their exact ranks are counted, and the
    result equals fusing the full rankings without building them. Where that depth exceeds ``max_depth`` (one
    rule's chunks fill the top of the list), the query's whole rankings are fused instead, as a distributed
    sort. ``chunk_id`` must run from 0 in order; anything else is an error.
    """
    n, low, high, ids = chunks.agg(F.count("*"), F.min("chunk_id"), F.max("chunk_id"), F.count_distinct("chunk_id")).first()
    if n and (low, high, ids) != (0, n - 1, n):
        raise ValueError("chunk_id must run from 0 without gaps or repeats")
    listed = dense_rules(chunks, queries, query_id, k, conduct_only)
    last = written(listed.groupBy(query_id).agg(F.max("rank").alias("found"), F.max_by("chunk_id", "rank").alias("chunk_id")))
    last_rank = dense.better_counts(chunks, queries, last, "chunk_id", query_id)
    depth = F.when(F.col("found") < k, n).otherwise(F.least(F.lit(n), rrf_k + 2 * F.col("rank")))
    every = written(last.join(last_rank, [query_id, "chunk_id"]).select(query_id, depth.cast("int").alias("depth")))
    depths = every.filter(F.col("depth") <= max_depth)
    deepest, n_deep = every.agg(F.max(F.when(F.col("depth") <= max_depth, F.col("depth"))), F.count_if(F.col("depth") > max_depth)).first()
    parts = []
    if deepest is not None:
        parts.append(_near_ranks(scores, chunks, queries.join(depths, query_id, "left_semi"), depths, deepest, n, query_id))
    if n_deep:
        deep = every.filter(F.col("depth") > max_depth)
        parts.append(_whole_ranks(scores.join(deep.select(query_id), query_id, "left_semi"), chunks, queries.join(deep, query_id, "left_semi"), query_id))
    if not parts:
        return listed.select(query_id, "chunk_id", "rule", "score", "rank")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fused = F.round(1 / (rrf_k + F.col("w")) + 1 / (rrf_k + F.col("d")), 15)  # far below the distance of neighbouring ranks, far above what doubles round
    book = searchable(chunks, conduct_only).select("chunk_id", R.base_rule(F.col("rule_no")).alias("rule"))
    scored = both.join(book, "chunk_id").withColumn("score", fused)
    return _top_rules(scored, query_id, k).select(query_id, "chunk_id", "rule", "score", "rank")


def _near_ranks(scores: DataFrame, chunks: DataFrame, queries: DataFrame, depths: DataFrame, deepest: int, n: int,
                query_id: str) -> DataFrame:
    """(query_id, chunk_id, w, d): both exact ranks of the chunks within a query's depth of either ranking."""
    near = dense.nearest(chunks, queries, "chunk_id", query_id, deepest)
    near = near.join(depths, query_id).filter("rank <= depth").select(query_id, "chunk_id")
    by_score = [F.col("score").desc(), F.col("chunk_id").asc()]
    matched = best_per_key(scores, [query_id], by_score, deepest, rank="rank").join(depths, query_id).filter("rank <= depth")
    # unmatched chunks follow in chunk order: among the first 2 x depth chunks at least depth are unmatched
    # when fewer than depth are matched
    counts = matched.groupBy(query_id).agg(F.max("rank").alias("found"))
    short = depths.join(counts, query_id, "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("found < depth")
    early = short.select(query_id, "depth", "found", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.least(F.lit(n), 2 * F.col("depth")).cast("bigint") - 1)).alias("chunk_id"))
    free = best_per_key(early.join(scores.select(query_id, "chunk_id"), [query_id, "chunk_id"], "left_anti"),
                        [query_id], [F.col("chunk_id").asc()], 2 * deepest, rank="_nth").filter("_nth <= depth - found")
    candidates = written(near.unionByName(matched.select(query_id, "chunk_id"))
                         .unionByName(free.select(query_id, "chunk_id")).distinct())

    dense_rank = dense.better_counts(chunks, queries, candidates, "chunk_id", query_id)
    word_rank = _bm25_ranks(scores, candidates, query_id)
    return word_rank.withColumnRenamed("rank", "w").join(dense_rank.withColumnRenamed("rank", "d"), [query_id, "chunk_id"])


def retrieval_hits(ranked: DataFrame, gold: DataFrame, query_id: str) -> DataFrame:
    """Per (query, retriever): whether a gold rule is ranked, 1 / its first rank (0 if none), and the rules listed.

    ``ranked`` has (retriever, query_id, rule, rank); ``gold`` has (query_id, gold array). A query without gold
    rules is not scored.
    """
    scored = gold.filter(F.size("gold") > 0)
    hit = F.when(F.array_contains(F.col("gold"), F.col("rule")), F.col("rank"))
    return ranked.join(scored, query_id).groupBy("retriever", query_id).agg(
        F.min(hit).alias("first"), F.sort_array(F.collect_list(F.struct("rank", "rule"))).alias("top")).select(
        "retriever", query_id, F.col("first").isNotNull().alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.transform("top", lambda t: t["rule"]).alias("top"))


def hit_rates(hits: DataFrame, *by: str) -> DataFrame:
    return hits.groupBy("retriever", *by).agg(F.count("*").alias("cases"), F.avg(F.col("hit").cast("int")).alias("hit_rate"),
                                              F.avg("rr").alias("mrr"))


def hits_by_series(hits: DataFrame, gold: DataFrame, query_id: str) -> DataFrame:
    series = F.array_distinct(F.transform("gold", lambda g: R.series_label(F.concat(F.lit("FINRA:"), g))))
    return hit_rates(hits.join(gold.select(query_id, F.explode(series).alias("series")), query_id), "series")


def hits_by_length(hits: DataFrame, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """Hit rates by third of text length in words, among the scored queries."""
    scored = queries.join(hits.select(query_id).distinct(), query_id, "left_semi")
    thirds = length_thirds(scored.select(query_id, text), F.size(words(F.coalesce(F.col(text), F.lit("")))), query_id)
    return hit_rates(hits.join(thirds.select(query_id, "third"), query_id), "third")


def slots_by_part(hits: DataFrame) -> DataFrame:
    """Share of all listed slots by part of the Rulebook, per retriever."""
    slots = hits.select("retriever", F.explode("top").alias("rule")).withColumn("part", R.rulebook_part(F.col("rule")))
    totals = slots.groupBy("retriever").agg(F.count("*").alias("total"))
    counts = slots.groupBy("retriever", "part").agg(F.count("*").alias("n"))
    return counts.join(totals, "retriever").select("retriever", "part", "n", (F.col("n") / F.col("total")).alias("share"))


def most_listed(hits: DataFrame, n: int = 10) -> DataFrame:
    """The n rules listed for most queries, with the share of queries, per retriever."""
    rules = hits.select("retriever", F.explode(F.array_distinct("top")).alias("rule")).groupBy("retriever", "rule").agg(
        F.count("*").alias("cases"))
    totals = hits.groupBy("retriever").agg(F.count("*").alias("total"))
    top = best_per_key(rules, ["retriever"], [F.col("cases").desc(), F.col("rule").asc()], n, rank="rank")
    return top.join(totals, "retriever").select("retriever", "rank", "rule", "cases", (F.col("cases") / F.col("total")).alias("share"))


def gold_by_part(gold: DataFrame) -> DataFrame:
    return value_shares(gold.select(F.explode("gold").alias("rule")).select(R.rulebook_part(F.col("rule")).alias("part")), "part")


def gold_in_book(gold: DataFrame, chunks: DataFrame, query_id: str) -> DataFrame:
    """Whether any gold rule of a scored query is among the indexed rules."""
    book = chunks.select(R.base_rule(F.col("rule_no")).alias("rule")).distinct().withColumn("_in", F.lit(1))
    rows = gold.select(query_id, F.explode("gold").alias("rule")).join(book, "rule", "left")
    return rows.groupBy(query_id).agg((F.count("_in") > 0).alias("gold_in_book"))


def excerpts(ranked: DataFrame, chunks: DataFrame, query_id: str) -> DataFrame:
    """Numbered excerpts of each query's ranked chunks as one text."""
    rows = ranked.select(query_id, "rank", "chunk_id").join(chunks.select("chunk_id", "rule_no", "title", "text"), "chunk_id")
    listed = rows.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", "rule_no", "title", "text"))).alias("c"))
    entry = F.transform("c", lambda c, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] Rule "), c["rule_no"], F.lit(": "), c["title"], F.lit("\n"), c["text"]))
    return listed.select(query_id, F.array_join(entry, "\n\n").alias("excerpts"))
