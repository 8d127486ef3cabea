"""Exact vector search: each task scores its chunks against a block of queries and keeps what can matter."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.operators.ordering import best_per_key
from casemill.sources.session import written

# tasks carry these helpers with them, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGITS = 9  # scores are rounded here before ranking, so equal vectors tie wherever they are computed
BLOCK_BYTES = 32 << 20


#: Rows of a tile: a pair of tiles has at most some four million scores.
QUERY_TILE, CHUNK_TILE = 1024, 4096


def normalised(vector: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero and so scores 0 everywhere."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(vector, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))


def query_blocks(queries: DataFrame, query_id: str, vector: str, carried_rows: int = 0,
                 block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """Query ids and unit vectors in blocks of bounded size, one block on the driver at a time.

    A block goes to every task of one pass over the chunks; more queries (or more vectors carried along with
    them) make more passes, never a larger broadcast. Yields (block, whether it is the only one).
    """
    rows = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v"))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return
    parts = -(-(n + carried_rows) * width * 8 // block_bytes)
    for part in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).toPandas().sort_values("q")
        if len(own):
            yield (own["q"].to_numpy(), _unit(own["v"])), parts == 1


def per_block(queries: DataFrame, query_id: str, vector: str, run, schema: str, carried_rows: int = 0) -> DataFrame:
    """The union of ``run(block)`` over all query blocks; with several, each is finished before the next is read."""
    spark, out = queries.sparkSession, None
    for block, only in query_blocks(queries, query_id, vector, carried_rows):
        found = run(block) if only else written(run(block))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1)


def _best(scores: np.ndarray, ids: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best groups, one row per group: highest score, then smallest id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(groups[order], return_index=True)
    return order[np.sort(first)[:k]]


def nearest(chunks: DataFrame, queries: DataFrame, chunk_id: str, query_id: str, k: int = C.TOP_K,
            group: str | None = None, vector: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, [group], score, rank): the k best chunks, or the best chunk of the k best groups.

    Every chunk is scored. Queries and chunks are dealt to tiles of bounded size and every query tile meets every chunk
    tile in one group of its own, which emits at most k rows per query; only those are shuffled again. Neither side
    passes through the driver, and a task holds one pair of tiles.
    """
    group_col = group or chunk_id
    types = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    q_type = {f.name: f.dataType.simpleString() for f in queries.schema.fields}[query_id]
    schema = f"q {q_type}, id {types[chunk_id]}, g {types[group_col]}, score double"
    n_queries, n_chunks = queries.count(), chunks.count()
    across, down = max(1, -(-n_queries // QUERY_TILE)), max(1, -(-n_chunks // CHUNK_TILE))

    def tiled(rows: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        """Each row in its own tile, once for each tile of the other side."""
        numbered = rows.withColumn(own, F.pmod(F.xxhash64(rows.columns[0]), F.lit(parts)))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))))
    left = tiled(queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")), "x", across, "y", down)
    right = tiled(chunks.select(F.col(chunk_id).alias("id"), F.col(group_col).alias("g"), F.col(vector).alias("v")), "y", down, "x", across)

    def pair(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(given):
            return pd.DataFrame({"q": asked["q"][:0], "id": given["id"][:0], "g": given["g"][:0], "score": np.zeros(0)})
        scores = np.round(_unit(asked["v"]) @ _unit(given["v"]).T, DIGITS)
        ids, groups = given["id"].to_numpy(), given["g"].to_numpy()
        best = [_best(row, ids, groups, k) for row in scores]
        at = np.concatenate(best)
        owner = np.repeat(np.arange(len(best)), [len(x) for x in best])
        return pd.DataFrame({"q": asked["q"].to_numpy()[owner], "id": ids[at], "g": groups[at], "score": scores[owner, at]})

    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(pair, schema)
    by_score = [F.col("score").desc(), F.col("id").asc()]
    if group:
        found = best_per_key(found, ["q", "g"], by_score)
    top = best_per_key(found, ["q"], by_score, k, rank="rank")
    named = [F.col("q").alias(query_id), F.col("id").alias(chunk_id)] + ([F.col("g").alias(group)] if group else [])
    return top.select(*named, "score", "rank")


def better_counts(chunks: DataFrame, queries: DataFrame, candidates: DataFrame, chunk_id: str, query_id: str,
                  vector: str = "embedding") -> DataFrame:
    """Exact dense rank of each candidate (query_id, chunk_id) among all chunks.

    A task counts, for each query, its chunks between neighbouring candidates; the counts add up to ranks.
    ``candidates`` is bounded per query (see fusion) and travels with the query blocks.
    """
    spark = chunks.sparkSession
    types = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    q_type = {f.name: f.dataType.simpleString() for f in queries.schema.fields}[query_id]
    rows = chunks.select(F.col(chunk_id).alias("id"), F.col(vector).alias("v"))
    wanted = candidates.select(F.col(query_id).alias("q"), F.col(chunk_id).alias("id"))
    schema = f"q {q_type}, id {types[chunk_id]}, better bigint"

    def count(block) -> DataFrame:
        names, matrix = block
        own = wanted.join(spark.createDataFrame(pd.DataFrame({"q": names}), f"q {q_type}"), "q", "left_semi")
        vectors = own.join(rows, "id").toPandas()  # bounded: the block counts these rows too
        at = {name: j for j, name in enumerate(names)}
        per_query = {}
        for name, part in vectors.groupby("q"):
            s = np.round(_unit(part["v"]) @ matrix[at[name]], DIGITS)
            order = np.lexsort((part["id"].to_numpy(), -s))
            per_query[name] = (part["id"].to_numpy()[order], s[order])
        shared = spark.sparkContext.broadcast((names, matrix, per_query))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix, per_query = shared.value
            totals = {name: np.zeros(len(per_query[name][0]) + 1, dtype=np.int64) for name in names if name in per_query}
            for batch in batches:
                if not len(batch):
                    continue
                scores = np.round(_unit(batch["v"]) @ matrix.T, DIGITS)
                ids = batch["id"].to_numpy()
                for j, name in enumerate(names):
                    if name in totals:
                        cand_ids, cand_scores = per_query[name]
                        totals[name] += np.bincount(_slots(cand_scores, cand_ids, scores[:, j], ids),
                                                    minlength=len(cand_ids) + 1)
            for name, total in totals.items():
                yield pd.DataFrame({"q": name, "id": per_query[name][0], "better": np.cumsum(total)[:-1]})
        return rows.mapInPandas(run, schema)

    out = per_block(queries, query_id, vector, count, schema, carried_rows=candidates.count())
    ranks = out.groupBy("q", "id").agg(F.sum("better").alias("better"))
    return ranks.select(F.col("q").alias(query_id), F.col("id").alias(chunk_id), (F.col("better") + 1).alias("rank"))


def _slots(cand_scores: np.ndarray, cand_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the first candidate it beats (score desc, id asc); len(candidates) if none.

    Candidates are sorted best first. A candidate itself lands in the slot after its own.
    """
    slot = np.searchsorted(-cand_scores, -scores, side="left")
    tied = (slot < len(cand_scores)) & (cand_scores[np.minimum(slot, len(cand_scores) - 1)] == scores)
    for r in np.flatnonzero(tied):
        p = slot[r]
        while p < len(cand_scores) and cand_scores[p] == scores[r] and cand_ids[p] <= ids[r]:
            p += 1
        slot[r] = p
    return slot


def all_scores(chunks: DataFrame, queries: DataFrame, chunk_id: str, query_id: str, vector: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, score) of every chunk for every query: only for queries that need whole rankings."""
    spark = chunks.sparkSession
    types = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    q_type = {f.name: f.dataType.simpleString() for f in queries.schema.fields}[query_id]
    rows = chunks.select(F.col(chunk_id).alias("id"), F.col(vector).alias("v"))
    schema = f"q {q_type}, id {types[chunk_id]}, score double"

    def score(block) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            for batch in batches:
                if len(batch):
                    scores = np.round(_unit(batch["v"]) @ matrix.T, DIGITS)
                    for j, name in enumerate(names):
                        yield pd.DataFrame({"q": name, "id": batch["id"].to_numpy(), "score": scores[:, j]})
        return rows.mapInPandas(run, schema)
    return per_block(queries, query_id, vector, score, schema).select(
        F.col("q").alias(query_id), F.col("id").alias(chunk_id), "score")
