"""Near duplicates among vectors of one label: int8 tiles with error bounds, exact where a pair may pass.

Equal vectors of a label meet first and go on as one class, with their number. The classes of a label are dealt into
blocks, and every two blocks meet in one tile. A tile multiplies the int8 forms (whole numbers, exact in float32). With
``u = s q + e`` for a unit vector, ``u.v <= s t (q.r) + |s q| |e_v| + |e_u|``, so pairs whose bound stays under the
threshold are out for certain; only the others are worked out in double precision. A tile hands on counts per class and
a spanning forest of its links, so its output grows with its rows and not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.components import components
from casemill.sources.session import written

#: Classes per block, about: a tile holds two blocks and their product.
BLOCK = 1024
#: Pairs worked out at once in double precision.
PAIRS = 50_000
#: Added to the bound for what float32 rounds in scaling the whole-number product.
SLACK = 1e-5


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows of doubles as int8, with scale, length of the scaled int8 row and length of the error, all per row."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = unit - scale[:, None] * q
    return q, scale, np.linalg.norm(scale[:, None] * q, axis=1), np.linalg.norm(error, axis=1)


def possible(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (doubles) whose cosine may reach the threshold."""
    qa, sa, ma, ea = quantised(a)
    qb, sb, _, eb = quantised(b)
    exact = np.float32 if 127 * 127 * a.shape[1] < 1 << 24 else np.float64
    product = qa.astype(exact) @ qb.astype(exact).T
    product *= sa[:, None].astype(exact)
    product *= sb[None, :].astype(exact)
    product += np.outer(ma, eb).astype(exact)
    return np.nonzero(product >= (threshold - SLACK - ea)[:, None].astype(exact))


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: the cosine in double precision reaches the threshold."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    rows, columns = possible(a, b, threshold)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for at in range(0, len(rows), PAIRS):
        i, j = rows[at:at + PAIRS], columns[at:at + PAIRS]
        out[i, j] = np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j]) >= threshold
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Some of the links (row, column) that connect all rows and columns which the links connect."""
    rows_left, columns_left = links.any(axis=1), np.ones(links.shape[1], dtype=bool)
    out: list[tuple[int, int]] = []
    for start in np.flatnonzero(rows_left).tolist():
        if not rows_left[start]:
            continue
        rows_left[start] = False
        todo = [(start, True)]
        while todo:
            at, is_row = todo.pop()
            left = columns_left if is_row else rows_left
            new = np.flatnonzero((links[at] if is_row else links[:, at]) & left)
            left[new] = False
            out += [(at, n) if is_row else (n, at) for n in new.tolist()]
            todo += [(n, not is_row) for n in new.tolist()]
    return out


def usable(vector: Column, label: Column) -> Column:
    """Has a label, and a vector without null or non-finite components that is not zero throughout."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def tiles(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b, n``: with b, a link of the forest; without, n linked vectors for class a in one tile.

    ``classes(id, label, vector, n)``. Blocks hold about ``block`` classes, by a hash of the id.
    """
    sized = classes.withColumn("size", F.size("vector"))
    blocks = sized.groupBy("label", "size").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    packed = (sized.join(blocks, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .groupBy("label", "size", "blocks", "block")
              .agg(F.collect_list(F.struct("id", "n", "vector")).alias("members")))
    sent = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("label", "size", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                       "block", F.col("members.id").alias("ids"), F.col("members.n").alias("ns"), F.flatten("members.vector").alias("values"))

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        size, parts = key[1].as_py(), []
        for i in sorted(range(table.num_rows), key=lambda i: table.column("block")[i].as_py()):
            ids, ns, values = (table.column(c)[i].values for c in ("ids", "ns", "values"))
            parts.append((ids.to_numpy(), ns.to_numpy(), values.to_numpy().astype(np.float64).reshape(-1, size)))
        (ia, na, a), (ib, nb, b) = parts[0], parts[-1]
        links = linked(a, b, threshold)
        if len(parts) == 1:
            np.fill_diagonal(links, False)
        found = forest(links)
        counts = [(ia, links @ nb), *([(ib, na @ links)] if len(parts) == 2 else [])]
        ends = [ids[n > 0] for ids, n in counts]
        a_out = np.concatenate([ia[[r for r, _ in found]] if found else ia[:0], *ends])
        b_out = np.concatenate([ib[[c for _, c in found]] if found else ib[:0], *ends])
        n_out = np.concatenate([np.zeros(len(found), np.int64), *[n[n > 0] for _, n in counts]])
        is_link = np.arange(len(a_out)) < len(found)
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64(), mask=~is_link), "n": pa.array(n_out, pa.int64())})

    return sent.groupBy("label", "size", "low", "high").applyInArrow(tile, "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows without a usable vector or label link with nothing: no links, their own id, kept. Vectors of unequal length
    do not link. Repeated rows are copies and link with one another. A null id counts in links; ``component_id`` is the
    smallest id that is not null, and a row whose id is null is kept only if nothing links to it. No rows give no rows.
    """
    rows = vectors.select("vec_id", F.col("label").alias("label"), F.col("embedding").alias("vector"))
    good = rows.filter(usable(F.col("vector"), F.col("label")))
    classes = written(good.groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
                      .withColumn("id", F.monotonically_increasing_id()))
    found = written(tiles(classes, threshold, block))
    roots = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    marked = written(classes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    smallest = marked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = (marked.join(smallest, "root").join(counts, "id", "left")
          .select("label", "vector", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    linked_rows = good.join(of, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    lone = rows.filter(~usable(F.col("vector"), F.col("label"))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0))
