"""Exact top-k search by inner product, columnar branch and bound.

Queries are taken in blocks of bounded size, each broadcast to the partitions of the candidates; candidates are never
shuffled. Inside a partition the vectors stand in vertical layout, and scores accumulate dimension block by dimension block.
After each block a candidate's score is at most what it has plus |rest of query| * |rest of candidate| (Cauchy-Schwarz);
candidates below the query's k-th best id so far leave, and the rest move together. Components are integers, sums are exact in
double precision (below 2^53), and the bound is widened by a relative 1e-9, so no candidate is lost to rounding.

Vectors that are null, empty, of another length than most (no inner product is defined), or hold null or non-finite components take no part. Rows of
one id count once, by their best vector: however many they are, they hold one place of the k. A query never meets its own id. Equal scores go to the smaller id. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.shared import work_dir, written

#: Dimensions of a block.
STEP = 8
#: Queries that are broadcast at once, about: 64 dimensions make 16 MB.
QUERIES = 32768


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of vectors that take part, one row an id."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _rows(column) -> np.ndarray:
    """A list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _tails(x: np.ndarray) -> np.ndarray:
    """Norm of each vector's components from each block's end on, blocks first."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], STEP), axis=1)
    after = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1] - squares
    return np.sqrt(np.maximum(after, 0)).T.copy()


class _Best:
    """The k best of each query so far: scores descending, ids ascending among equals."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.ids, self.scores = k, np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))
        new, first = np.unique(ids[order], return_index=True)
        first = np.sort(first[new >= 0]) if (new >= 0).any() else first[:0]
        order = order[first][: self.k]
        self.ids[q], self.scores[q] = -1, -np.inf
        self.ids[q, : len(order)], self.scores[q, : len(order)] = ids[order], scores[order]


def _kth(values: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The k-th best of ids, each by its best value; -inf if they are fewer. ids: sorted, or all different."""
    if (ids[1:] == ids[:-1]).any():
        values = np.maximum.reduceat(values, np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1]))
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def search_block(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: _Best) -> None:
    """Adds the candidates (ids, vectors) that belong to the k best of some query."""
    if len(np.unique(ids)) < len(ids):  # rows of one id side by side
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
    columns = np.ascontiguousarray(vectors.T)  # vertical: a row a dimension
    tails, own_tails = _tails(vectors), _tails(queries)
    dims = columns.shape[0]
    for q in range(len(q_ids)):
        least = best.scores[q, -1]
        alive = np.flatnonzero(ids != q_ids[q])
        score = np.zeros(len(alive))
        for b, d in enumerate(range(0, dims, STEP)):
            block = columns[d : d + STEP]
            score += queries[q, d : d + STEP] @ (block if len(alive) == block.shape[1] else block[:, alive])
            if not np.isfinite(least):
                if len(alive) <= best.k:
                    continue
                # a floor of its own: the k-th best of what every id reaches at least
                low = _kth(score - own_tails[b, q] * tails[b, alive], ids[alive], best.k)
                if not np.isfinite(low):
                    continue
            else:
                low = least
            reach = score + own_tails[b, q] * tails[b, alive]
            keep = reach >= low - 1e-9 * (1 + abs(low))
            if not keep.all():
                alive, score = alive[keep], score[keep]
            if not len(alive):
                break
        if len(alive):
            if len(alive) > 4 * best.k:
                cut = _kth(score, ids[alive], best.k)
                alive, score = alive[score >= cut], score[score >= cut]
            best.add(q, ids[alive], score)


def _search(block, k: int):
    def rows(batches):
        q_ids, queries = block.value
        best = _Best(len(q_ids), k)
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), _rows(batch.column(1))
            if len(ids) and len(q_ids):
                search_block(q_ids, queries, ids, vectors, best)
        at = np.nonzero(best.ids >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[0]]), pa.array(best.ids[at]), pa.array(best.scores[at].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return rows


def top_k(vectors: DataFrame, is_query: str, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query.

    Components become floor(scale * x). is_query: SQL over `id`."""
    spark = vectors.sparkSession

    def best_of(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")

    rows = usable(vectors, key, vector).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    rows = written(rows.dropDuplicates(["id", "v"]), work_dir(spark, "topk"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, vec_id long, score long"
    if length is None:
        found = spark.createDataFrame([], schema)
    else:
        rows = rows.where(F.size("v") == length.n)
        queries = rows.where(is_query)
        parts, path = max(1, -(-queries.count() // block)), work_dir(spark, "topk-found")
        for part in range(parts):
            own = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
            ids, matrix = own.column("id").to_numpy(), _rows(own.column("v"))
            # where many rows hash alike, what is broadcast still keeps its size
            for a in range(0, max(1, len(ids)), 2 * block):
                held = spark.sparkContext.broadcast((ids[a : a + 2 * block], matrix[a : a + 2 * block]))
                # each block is searched and written before the next one is read: the driver holds one
                best_of(rows.mapInArrow(_search(held, k), schema)).write.mode("append").parquet(path)
                held.destroy()
        found = spark.read.schema(f"{schema}, rank int").parquet(path)
    return found.select("query_id", "rank", "vec_id", "score") if length else best_of(found).select("query_id", "rank", "vec_id", "score")
