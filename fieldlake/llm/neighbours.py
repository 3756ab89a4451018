"""Operator 3: nearest neighbours by inner product, through an inverted multi-index.

Both halves of the vectors are quantised by a codebook of their own; a cell is a
pair of centroids.  Codebooks are fitted on a bounded sample (``SAMPLE`` rows with
the smallest hash of their id); every row is indexed.  A query walks the cells by
the sum of its two distances, best first, with a heap over pairs of sorted lists,
until they hold the share ``VISIT`` of all entries (``LEAST_ENTRIES`` at least); the
distance it stops at marks what it visits.  Those entries are reranked exactly.

Entries are dealt to shards of ``BLOCK`` rows in cell order, so a crowded cell is
several shards, and queries meet a shard in blocks of ``QUERY_BLOCK``.  A vector
that many rows share keeps only the rows with the smallest ids that a result can
need.  The driver holds the sample, the codebooks and one count per cell; their
size is set by the parameters, not by the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.staging import stage

NEAREST, SAMPLE, CENTROIDS, ROUNDS = 20, 20_000, 128, 10
VISIT, LEAST_ENTRIES = 0.4, 4096
BLOCK, QUERY_BLOCK = 4096, 1024


def distances(queries: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """How far centroids are, as the negative inner product: the sum over both halves estimates that of the whole."""
    return -(queries @ codebook.T)


def fit_codebook(rows: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``rows`` by Lloyd's rounds; the same rows give the same centroids."""
    chosen = np.unique(rows, axis=0)
    centroids = chosen[np.random.default_rng(5).permutation(len(chosen))[:size]]
    for _ in range(rounds):
        nearest = assign(rows, centroids)
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def assign(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the centroid with the smallest Euclidean distance."""
    return np.argmin((centroids**2).sum(axis=1) - 2 * rows @ centroids.T, axis=1)


@dataclass
class MultiIndex:
    """Two codebooks and the entries of each cell."""

    codebooks: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray | None = None

    def cells(self, rows: np.ndarray) -> np.ndarray:
        half = self.codebooks[0].shape[1]
        return assign(rows[:, :half], self.codebooks[0]) * len(self.codebooks[1]) + assign(rows[:, half:], self.codebooks[1])

    def halves(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.codebooks[0].shape[1]
        return distances(queries[:, :half], self.codebooks[0]), distances(queries[:, half:], self.codebooks[1])

    def walk(self, first: np.ndarray, second: np.ndarray, wanted: int) -> tuple[list[int], float]:
        """Cells in order of summed distance until they hold ``wanted`` entries, and the last distance."""
        one, two = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
        a, b, width, counts = first[one].tolist(), second[two].tolist(), len(two), self.counts
        heap, cells, held, last = [(a[0] + b[0], 0, 0)], [], 0, 0.0
        while heap and held < wanted:
            last, i, j = heapq.heappop(heap)
            cell = one[i] * width + two[j]
            cells.append(cell)
            held += int(counts[cell])
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return cells, last


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of equally long vectors as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id long, vector array<double>``: rows that take part, each (id, vector) once."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null")
    finite = F.forall("vector", lambda x: F.coalesce(~x.isin(float("inf"), float("-inf")) & ~F.isnan(x), F.lit(False)))
    rows = rows.where((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (lengths.n if lengths else 0)).dropDuplicates(["vec_id", "vector"])


RESULT = "query_id long, vec_id long, score double"


def search(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, visit: float = VISIT, centroids: int = CENTROIDS) -> DataFrame:
    """The nearest rows by inner product of every row that ``is_query`` (a condition on ``vec_id``) marks.

    Returns ``query_id long, rank int, vec_id long, score double``: at most
    ``nearest`` rows a query, ties to the smaller id, never its own id.  Null ids,
    null or zero vectors, vectors with null or non-finite components and those whose
    length is not the most frequent one take no part; a repeated row counts
    once.  Without a usable row the result is empty.
    """
    rows = stage(usable(df, id_col, vector_col), "neighbours-rows")
    spark = df.sparkSession
    # of equal vectors a result needs the smallest ids only: as many as it has rows, and the query's own
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = rows.withColumn("copy", rank).where(F.col("copy") <= nearest + 1).drop("copy")
    sample = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    data = np.array([r.vector for r in sample], dtype=np.float64)
    size, half = min(centroids, max(1, int(len(data) ** 0.5))), data.shape[1] // 2
    index = MultiIndex((fit_codebook(data[:, :half], size), fit_codebook(data[:, half:], size)))
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(shared.value.cells(matrix(batch.column("vector"))), pa.int64()))

    placed = stage(entries.mapInArrow(place, "vec_id long, vector array<double>, cell long"), "neighbours-cells")
    index.counts = np.zeros(len(index.codebooks[0]) * len(index.codebooks[1]), dtype=np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row per cell
        index.counts[r.cell] = r["count"]
    begins = np.cumsum(index.counts) - index.counts
    wanted = max(LEAST_ENTRIES, int(np.ceil(visit * index.counts.sum())))
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    counted = spark.sparkContext.broadcast((index, begins))

    def shards(cells: np.ndarray) -> np.ndarray:
        filled = cells[counted.value[0].counts[cells] > 0]
        low, high = counted.value[1][filled] // BLOCK, (counted.value[1][filled] + counted.value[0].counts[filled] - 1) // BLOCK
        return np.unique(np.concatenate([low, *(low[high - low >= k] + k for k in range(1, int((high - low).max(initial=0)) + 1))]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multi = counted.value[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = multi.halves(matrix(batch.column("vector")))
            row, shard, reach = [], [], []
            for i in range(batch.num_rows):
                cells, last = multi.walk(first[i], second[i], wanted)
                found = shards(np.array(cells, dtype=np.int64))
                row += [i] * len(found)
                shard += found.tolist()
                reach.append(last)
            out = batch.append_column("reach", pa.array(reach, pa.float64())).take(pa.array(row, pa.int64()))
            yield out.append_column("shard", pa.array(shard, pa.int64()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multi, at = counted.value
        for batch in batches:
            cells, ids = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % np.maximum(multi.counts[cells], 1)
            yield batch.append_column("shard", pa.array((at[cells] + spread) // BLOCK))

    asked = queries.mapInArrow(ask, "vec_id long, vector array<double>, reach double, shard long")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    dealt = placed.mapInArrow(deal, "vec_id long, vector array<double>, cell long, shard long")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        return _rerank(counted.value[0], left, right, nearest)

    near = asked.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(rerank, RESULT)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", order).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _rerank(index: MultiIndex, asked: pa.Table, entries: pa.Table, nearest: int) -> pa.Table:
    """The best of a shard's visited entries for each query of a block, scored on the original vectors."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if asked.num_rows and entries.num_rows:
        queries, rows = matrix(asked.column("vector").combine_chunks()), matrix(entries.column("vector").combine_chunks())
        names, ids = asked.column("vec_id").to_numpy(), entries.column("vec_id").to_numpy()
        cells, reach = entries.column("cell").to_numpy(), asked.column("reach").to_numpy()
        first, second = index.halves(queries)
        one, two = np.divmod(cells, len(index.codebooks[1]))
        scores = queries @ rows.T
        for i in range(len(queries)):
            slack = 1e-9 * (1 + abs(reach[i]))
            at = np.flatnonzero((first[i][one] + second[i][two] <= reach[i] + slack) & (ids != names[i]))
            if len(at) > nearest:
                least = np.partition(scores[i, at], -nearest)[-nearest]
                at = at[scores[i, at] >= least - 1e-9 * (1 + abs(least))]
            exact = (rows[at] * queries[i]).sum(axis=1)  # equal vectors have equal scores, wherever they stand
            best = np.lexsort((ids[at], -exact))[:nearest]
            out["query_id"].append(np.full(len(best), names[i]))
            out["vec_id"].append(ids[at][best])
            out["score"].append(exact[best])
    columns = [pa.array(np.concatenate(v) if v else [], k) for v, k in zip(out.values(), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
    return pa.table(columns, names=list(out))
