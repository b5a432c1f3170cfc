"""Nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, and each half is quantised with a codebook of its own; a pair of centroids is a
cell.  For a query, the pairs are traversed with a heap in the order of their summed distance (here the negated
sum of the two inner products, as nearness is the inner product) until the cells hold enough entries.  The distance of
the last cell then says which cells those were.  Cells that lie side by side form groups of a bounded number of
entries; a query goes to the groups that hold any of its cells, and there every entry of its cells gets its exact inner
product in double precision.

Equal vectors are one entry with its smallest ids, as many as a result can use; the others cannot be in any result.
Full cells are cut into several groups, and a group's queries come in blocks, so neither is a hot group.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import batch_rows, materialize, partitions

FIT_ROWS = 20_000
SHARE = 0.4  # of the entries that a query's cells hold at least; recall 0.94 on vectors without any clusters
LEAST = 3_000  # entries, where the share is less
BLOCK = 4_096
CENTRES = 128  # of each half at most; a query walks about half of the grid of their pairs
NEIGHBOURS = "query_id long, rank int, vec_id long, score double"


def usable(v: Column) -> Column:
    """Not null, not empty or zero, all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """v (array<double>) and ids (the k + 1 smallest, sorted) of each different vector.

    Two steps, so that a vector that a large part of all rows share is gathered in about the square root of its rows.
    """
    n = max(1, int(math.sqrt(vectors.count())))
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    some = salted.groupBy("v", "salt").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    return some.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds; one that loses all its points starts again at the worst served point."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for c, p in zip(np.flatnonzero(n == 0), np.argsort(-far), strict=False):
            centres[c] = points[p]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = (centres ** 2).sum(axis=1)[None, :] - 2 * points @ centres.T
    near = apart.argmin(axis=1)
    return near, apart[np.arange(len(points)), near] + (points ** 2).sum(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> tuple[float, set[int]]:
    """Take cells in the order of summed distance until they hold ``wanted`` entries: the last distance, and the cells.

    ``first`` and ``second`` are a query's distances to both codebooks; sizes[i, j] is the number of entries of a cell.
    """
    order_a, order_b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    near_a, near_b = first[order_a].tolist(), second[order_b].tolist()
    held = sizes[np.ix_(order_a, order_b)].tolist()
    a, b = order_a.tolist(), order_b.tolist()
    # each row of the grid waits in the heap with its next column; a row enters when the one before it has started
    heap, found, last, cells = [(near_a[0] + near_b[0], 0, 0)], 0, -math.inf, set()
    while heap and (found < wanted or heap[0][0] <= last):
        last, i, j = heap[0]
        if n := held[i][j]:
            found += n
            cells.add(a[i] * len(b) + b[j])
        if j + 1 < len(b):
            heapq.heapreplace(heap, (near_a[i] + near_b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (near_a[i + 1] + near_b[0], i + 1, 0))
    return last, cells


def grouped(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first group and number of groups: neighbouring cells share one, full cells have several."""
    group, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    now = filled = 0
    for cell in np.flatnonzero(sizes):
        n = int(sizes[cell])
        if filled and filled + n > block:
            now, filled = now + 1, 0
        group[cell], parts[cell] = now, -(-n // block)
        if n > block:
            now, filled = now + int(parts[cell]), 0
        else:
            filled += n
    return group, parts


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, fit_rows: int = FIT_ROWS, share: float = SHARE,
               least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of largest inner product found for each query.

    ``vectors`` and ``queries`` have vec_id and embedding (float arrays); a query is never its own neighbour.  Vectors that are
    null, empty, zero, or hold null or non-finite components take no part; nor do those of another dimension than
    most have.  Ties go to the smaller vec_id.  With k candidates or fewer, all are returned; an empty table gives no
    rows; other columns are ignored.  Codebooks are fitted on a sample of about ``fit_rows`` different vectors and have at most
    CENTRES centroids each, so that they and the sizes of the cells (16,384 numbers at most) are all that is broadcast.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
        return rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))

    rows, asked = clean(vectors), clean(queries)
    wide = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if wide is None:
        return spark.createDataFrame([], NEIGHBOURS)
    d, rows, asked = wide["d"], rows.where(F.size("v") == wide["d"]), asked.where(F.size("v") == wide["d"])
    kept = materialize(entries(rows, k), "ann-entries")
    n = kept.count()
    sample = kept.select("v").sample(fraction=min(1.0, fit_rows / n), seed=42).toPandas()["v"]
    if not len(sample):
        sample = kept.select("v").limit(1).toPandas()["v"]
    points = np.stack(sample.to_numpy()).astype(np.float64)
    half, size = d // 2, int(np.clip(round(1.25 * math.sqrt(n)), 1, CENTRES))
    books = (codebook(points[:, :half], size) if half else np.zeros((1, 0)), codebook(points[:, half:], size))
    wanted = max(least, math.ceil(share * n))

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 4096):
            v = _matrix(batch["v"], d)
            cell = nearest(v[:, :half], books[0])[0] * len(books[1]) + nearest(v[:, half:], books[1])[0]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", "v", "ids"])

    index = materialize(kept.mapInArrow(quantised, "cell int, v array<double>, ids array<long>"), "ann-index")
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    grid = sizes.reshape(len(books[0]), len(books[1]))
    group, parts = grouped(sizes, block)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 256):
            v = _matrix(batch["v"], d)
            first, second = -(v[:, :half] @ books[0].T), -(v[:, half:] @ books[1].T)
            limits, groups = [], []
            for q in range(len(v)):
                last, cells = traverse(first[q], second[q], grid, wanted)
                limits.append(last)
                groups.append(sorted({int(group[c]) + k for c in cells for k in range(parts[c])}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(limits), pa.array(groups, pa.list_(pa.int64()))],
                                             names=["query_id", "v", "reach", "groups"])

    asked = asked.select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    asked = asked.repartition(partitions(spark))  # few small rows, much work for each
    routes = materialize(asked.mapInArrow(routed, "query_id long, v array<double>, reach double, groups array<long>"), "ann-routes")
    blocks = max(1, math.ceil(routes.count() / block))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch["cell"].to_numpy(zero_copy_only=False)
            own = group[cell] + np.array([i[0] for i in batch["ids"].to_pylist()], np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], names=["group", "cell", "v", "ids"])

    numbered = index.mapInArrow(dealt, "group long, cell int, v array<double>, ids array<long>")
    spread_entries = numbered.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread_queries = routes.select("query_id", "v", "reach", F.explode("groups").alias("group"),
                                   F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q"))

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, float, list[int]]] = []
        if len(mine) and len(theirs):
            x, y = np.stack(mine["v"].to_numpy()), np.stack(theirs["v"].to_numpy())
            ids, cell = theirs["ids"].to_numpy(), theirs["cell"].to_numpy()
            reach, names = mine["reach"].to_numpy(), mine["query_id"].to_numpy()
            for at in range(0, len(x), 128):
                own = x[at:at + 128]
                apart = -(own[:, :half] @ books[0].T)[:, cell // len(books[1])] - (own[:, half:] @ books[1].T)[:, cell % len(books[1])]
                rough = np.where(apart <= reach[at:at + 128, None] + 1e-12, own @ y.T, -np.inf)
                best = min(k + 1, len(y))
                floor = np.partition(rough, len(y) - best, axis=1)[:, len(y) - best]
                slack = np.where(np.isfinite(floor), 1e-9 * (1 + np.abs(floor)), 0.0)
                a, b = np.nonzero((rough >= (floor - slack)[:, None]) & np.isfinite(rough))
                exact = (own[a] * y[b]).sum(axis=1)
                out.extend(zip(names[at + a].tolist(), exact.tolist(), ids[b], strict=True))
        return pd.DataFrame(out, columns=["query_id", "score", "ids"])

    met = spread_queries.groupBy("group", "q").cogroup(spread_entries.groupBy("group", "q")).applyInPandas(
        meet, "query_id long, score double, ids array<long>")
    found = met.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
