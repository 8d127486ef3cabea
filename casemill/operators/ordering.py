"""Row order: first and last per key, carry forward, global row numbers, quantiles, thirds, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.sources.session import written


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
                 rank: str | None = None) -> DataFrame:
    """The first k rows per key in the given order.

    Spark prunes each task to k rows per key before the shuffle, so a key that holds a third of all rows
    sends k rows per task, not the third.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in report order."""
    return best_per_key(df, keys, [F.col(c).desc_nulls_last() for c in order])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return best_per_key(df, keys, [F.col(c).asc() for c in order])


def best_source(df: DataFrame, month: str = "month", is_pdf: str = "is_pdf", pos: str = "pos") -> DataFrame:
    """One source per month: a PDF before a page, then the earlier candidate."""
    return best_per_key(df, [month], [F.col(is_pdf).desc(), F.col(pos).asc()])


def first_with_result(df: DataFrame, key: str, has_result: Column, order: Column) -> DataFrame:
    """Per key the first row (in ``order``) with a result, or the last row where none has one."""
    rows = df.withColumn("_has", has_result).withColumn("_at", order)
    picked = rows.groupBy(key).agg(
        F.min_by(F.struct(*df.columns), F.when(F.col("_has"), F.col("_at"))).alias("hit"),
        F.max_by(F.struct(*df.columns), F.col("_at")).alias("last"), F.count("*").alias("n_docs"))
    return picked.select(F.coalesce("hit", "last").alias("row"), "n_docs").select("row.*", "n_docs")


def fallback_sources(sources: Sequence[DataFrame], key: str, item: str) -> DataFrame:
    """Items of the first source that has any for a key; sources in order of preference."""
    tagged = [s.select(key, item).filter(F.col(item).isNotNull()).withColumn("source", F.lit(i))
              for i, s in enumerate(sources)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    chosen = rows.groupBy(key).agg(F.min("source").alias("source"))
    return rows.join(chosen, [key, "source"])


def _ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with ``_part``, the number of their range, and ``_at``, their place in it (0 first).

    Ranges follow one another in the given order and rows that tie in it share one. The rows are written once: two
    evaluations could draw different ranges.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_id", F.monotonically_increasing_id()))
    return written(placed.withColumn("_part", F.shiftright("_id", 33).cast("int"))
                   .withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"))


def _before(totals: DataFrame, total: str, out: str) -> DataFrame:
    """``_part`` and the sum of ``total`` over the ranges before it; one row per range, so the running sum is small."""
    before = F.sum(total).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    return totals.select("_part", F.coalesce(before, F.lit(0)).alias(out))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The last non-null value at or before each row, per key.

    Rows are cut into ranges by key and order, so a key with many rows is carried in many tasks. Only the first key of
    a range can have rows in the range before; its value there is handed on, one row per range.
    """
    placed = _ranges(df, [F.col(c) for c in [*keys, *order]])
    within = F.last(value, ignorenulls=True).over(
        W.partitionBy("_part", *keys).orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    # a key that reaches over a border of ranges is the last of one and the first of the next
    names = [F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)]
    last = placed.groupBy("_part", *names).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_last"), F.min("_at").alias("_first"))
    border = W.orderBy("_part", "_first")
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"_key{i}").eqNullSafe(F.col(f"_was{i}"))
    ends = last.withColumn("_top", F.max("_first").over(W.partitionBy("_part"))).filter(
        (F.col("_first") == 0) | (F.col("_first") == F.col("_top")))
    # at most two rows per range: its first key and its last
    for i in range(len(keys)):
        ends = ends.withColumn(f"_was{i}", F.lag(f"_key{i}").over(border))
    ends = ends.withColumn("_run", F.sum(F.when(F.coalesce(same, F.lit(False)) & F.lag("_part").over(border).isNotNull(), 0).otherwise(1)).over(border))
    carried = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(
        W.partitionBy("_run").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    carried = carried.filter("_first = 0 and _carried is not null").select(F.col("_part").alias("_into"), *[f"_key{i}" for i in range(len(keys))], "_carried")
    here = F.col("_part") == F.col("_into")
    for i, c in enumerate(keys):
        here = here & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    rows = placed.withColumn("_within", within).join(F.broadcast(carried), here, "left")
    return rows.select(*[c for c in df.columns if c != out], F.coalesce("_within", "_carried.v").alias(out))


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """1-based row numbers in a total order, without moving all rows to one task.

    Range-partition and sort once, keep each row's place within its partition, and add the sizes of the
    partitions before it.
    """
    placed = _ranges(df, order)
    offsets = _before(placed.groupBy("_part").agg(F.count("*").alias("_rows")), "_rows", "_offset")
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_at") + 1).drop("_part", "_at", "_offset"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """0-based gapless row numbers in no particular order. The rows are written once and not shuffled."""
    placed = written(df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33).cast("int")))
    offsets = _before(placed.groupBy("_part").agg(F.count("*").alias("_rows")), "_rows", "_offset")
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_id", "_offset"))


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles per group, one column each, named q25 for 0.25 and q2_5 for 0.025, and the count ``n``.

    Exact by selection: different values are counted map-side and cut into ranges by group and value, running counts
    give each value's ranks, and only the values at the wanted ranks are kept. No group's values meet in one task.
    Null values do not count; a group of nulls alone has null quantiles.
    """
    names = [f"q{100 * q:g}".replace(".", "_") for q in at]
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_value"))
    # nulls sort first in their group; they add 0, so every group keeps its ranks and its row
    placed = _ranges(rows.groupBy(*keys, "_value").agg(F.count("_value").alias("_rows")), [F.col(c) for c in [*keys, "_value"]])
    offsets = _before(placed.groupBy("_part").agg(F.sum("_rows").alias("_rows")), "_rows", "_offset")
    within = F.sum("_rows").over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    ranked = written(placed.withColumn("_upto", within).join(F.broadcast(offsets), "_part").select(
        *keys, "_value", "_rows", (F.col("_upto") + F.col("_offset")).alias("_upto")))
    groups = ranked.groupBy(*keys).agg(F.sum("_rows").alias("n"), F.min(F.col("_upto") - F.col("_rows")).alias("_start"))
    groups = groups.select(*[F.col(k).alias(f"_g{k}") for k in keys], "n", "_start")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g{k}"))
    upto = F.col("_upto") - F.col("_start")

    def ranked_at(rank: Column) -> Column:
        return F.max(F.when((rank < upto) & (rank >= upto - F.col("_rows")), F.col("_value")))
    picked = []
    for i, q in enumerate(at):
        position = F.lit(float(q)) * (F.col("n") - 1)
        picked += [ranked_at(F.floor(position)).alias(f"_low{i}"), ranked_at(F.ceil(position)).alias(f"_high{i}")]
    chosen = ranked.join(groups, same).groupBy(*keys, "n").agg(*picked)

    def between(i: int, q: float) -> Column:
        position = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.col(f"_low{i}").cast("double"), F.col(f"_high{i}").cast("double")
        return F.when(low == high, low).otherwise(low + (position - F.floor(position)) * (high - low))
    return chosen.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", *[between(i, q).alias(c) for i, (q, c) in enumerate(zip(at, names))])


def length_thirds(df: DataFrame, length: Column, key: str, out: str = "third") -> DataFrame:
    """Short, medium and long thirds by rank of length, ties by key; bin edges as equal-frequency quantiles."""
    ranked = global_row_number(df.withColumn("_length", length), [F.col("_length"), F.col(key)], "_rank")
    n = ranked.agg(F.count("*")).scalar()
    at = 3 * (F.col("_rank") - 1)
    third = F.when(at < n - 1, "short").when(at < 2 * (n - 1), "medium").otherwise("long")
    # fewer than three rows: one bin each
    third = F.when(n >= 3, third).otherwise(F.when(F.col("_rank") == 1, "short").otherwise("medium"))
    return ranked.withColumn(out, third).drop("_length", "_rank")


def hash_order(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def mixed(value: Column) -> Column:
    """Repeatable integer mixing below 2^31 - 1, the same in any SQL engine with 64-bit integers."""
    p = 2147483647
    once = F.pmod(F.pmod(value, F.lit(p)) * 48271 + 11, F.lit(p))
    return F.pmod(F.pmod(once * once + 12345, F.lit(p)) * 69621, F.lit(p))


def seeded_sample(df: DataFrame, n: int, order: Column, key: str) -> DataFrame:
    """min(n, rows) rows without replacement; the same rows whatever the partitioning."""
    return df.orderBy(order, key).limit(n)
