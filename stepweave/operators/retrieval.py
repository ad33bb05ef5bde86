"""Vector retrieval for a bounded set of queries, and text chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.sources.places import work_dir

#: Queries that are compared in one pass; the rest follow in further passes.
QUERY_BLOCK = 4096


def scores(queries: DataFrame, base: DataFrame, key: str, vector: str, kind: str = "cosine", keep: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, key, score) of each query against all rows, by blocks of queries that are broadcast.

    Each partition of the base keeps `keep` rows a query, or those of `least` and above: pairs are never all written out.
    Vectors that are null, empty or hold null or non-finite components take no part, nor do zero vectors with cosine; a query meets
    vectors of its own length."""
    spark = base.sparkSession

    def usable(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"))
        rows = rows.where(~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & (F.size("v") > 0))
        return rows.where(F.exists("v", lambda x: x != 0)) if kind == "cosine" else rows

    names, rows = usable(queries, "q"), usable(base, "k")
    parts = max(1, -(-names.count() // QUERY_BLOCK))

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True) if kind == "cosine" else x

    def by_length(column) -> Iterator[tuple[int, np.ndarray]]:
        """(length, rows of that length)."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
        for size in np.unique(sizes):
            yield int(size), np.flatnonzero(sizes == size)

    def run(held):
        def batches(it) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for size, some in by_length(batch.column(1)):
                    if size not in held.value:
                        continue
                    ids, q = held.value[size]
                    own = batch.column(0).to_numpy()[some]
                    s = q @ unit(batch.column(1).take(pa.array(some)).flatten().to_numpy().reshape(-1, size)).T
                    if keep is not None and s.shape[1] > keep:
                        cut = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]
                        i, j = np.nonzero(s >= cut)
                    else:
                        i, j = np.nonzero(s >= (-np.inf if least is None else least))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j]), pa.array(s[i, j])], names=["query_id", key, "score"])

        return batches

    schema, path, found = f"query_id long, {key} long, score double", None, None
    for part in range(parts):
        table = names.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).toArrow()
        ids, column = table.column("q").to_numpy(), table.column("v").combine_chunks()
        vectors = {size: (ids[some], unit(column.take(pa.array(some)).flatten().to_numpy().reshape(-1, size))) for size, some in by_length(column)}
        held = spark.sparkContext.broadcast(vectors)
        found = rows.mapInArrow(run(held), schema)
        if parts > 1:  # each block is searched and written before the next one is read: the driver holds one
            path = path or work_dir(spark, "scores")
            found.write.mode("append").parquet(path)
            held.destroy()
    return spark.read.schema(schema).parquet(path) if path else found


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, kind: str = "cosine", skip_self: bool = True) -> DataFrame:
    """The k best rows of each query with `rank` from 1; ties to the smaller key."""
    found = scores(queries, base, key, vector, kind, keep=k + int(skip_self))
    found = found.where(F.col("query_id") != F.col(key)) if skip_self else found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(f"rank <= {k}")


def within(queries: DataFrame, base: DataFrame, key: str, vector: str, distance: float, most: int | None = None) -> DataFrame:
    """Rows nearer than a cosine distance, at most `most` a query."""
    found = scores(queries, base, key, vector, least=1 - distance).where((F.col("query_id") != F.col(key)) & (1 - F.col("score") < distance))
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(f"rank <= {most}").drop("rank")


def containing(docs: DataFrame, text: str, needle: str) -> DataFrame:
    return docs.where(F.contains(F.col(text), F.lit(needle)))


# Shorter chunks are dropped; a line that is broken counts as so much of its tokens, and a little more.
LEAST_CHUNK = 5
BROKEN_SHARE, BROKEN_MORE = 0.9, 0.1


class _Rest:
    """What is left of a text: a head (a line, or what is left of one that was broken) and the lines after it, by prefix sums."""

    def __init__(self, text: str, count: Callable[[str], int]) -> None:
        self.lines, self.count = text.split("\n"), count
        costs = [count(line) for line in self.lines]
        self.sums = [0, *accumulate(costs)]
        self.blank = [i for i, line in enumerate(self.lines) if not line.strip()]
        self.at, self.head, self.head_cost = 0, self.lines[0], costs[0]

    def __len__(self) -> int:
        return len(self.lines) - self.at

    def cost(self) -> int:
        return self.head_cost + self.sums[-1] - self.sums[self.at + 1] if len(self) else 0

    def best_cut(self, most: int, below: int, only_blank: bool) -> int:
        """The largest number of lines under `below` that costs at most `most` (and that a blank line follows); 0 if there is none."""
        furthest = bisect_right(self.sums, most - self.head_cost + self.sums[self.at + 1]) - 1
        furthest = min(furthest, self.at + below - 1)
        if only_blank:
            i = bisect_right(self.blank, furthest) - 1
            furthest = self.blank[i] if i >= 0 else self.at
        return max(0, furthest - self.at)

    def text(self, n: int) -> str:
        return "\n".join([self.head, *self.lines[self.at + 1 : self.at + n]]) if n else ""

    def drop(self, n: int) -> None:
        self.at += n
        if len(self):
            self.head, self.head_cost = self.lines[self.at], self.sums[self.at + 1] - self.sums[self.at]

    def break_head(self, size: int) -> str:
        piece, self.head = self.head[:size], self.head[size:]
        self.head_cost = self.count(self.head)
        return piece


def chunks_of(text: str, most: int, count: Callable[[str], int], break_at_blank: bool = True, overlap: int = 0, one_line: bool = False) -> list[str]:
    """Chunks of whole lines within a budget of tokens, for as long as what is left is over it.

    A chunk takes as many lines as fit, up to the share of the lines that the budget is of the tokens left (one_line: a
    line), and ends before a blank line while break_at_blank holds; the first time that none is in reach it is given up. Where
    not even a line fits, its beginning becomes a chunk. `overlap` lines come again where a chunk has more than that."""
    rest, made = _Rest(text, count), []
    only_blank = break_at_blank and not one_line and len(rest) >= 3
    again = 0 if one_line else overlap
    while (cost := rest.cost()) > most:
        below = 2 if one_line else max(2, int(most / cost * len(rest)))
        n = rest.best_cut(most, min(below, len(rest)), only_blank)
        if n:
            made.append(rest.text(n))
            rest.drop(n - again if n > again else n)
        elif only_blank:
            only_blank = False
        else:
            made.append(rest.break_head(max(LEAST_CHUNK, int(most / (rest.head_cost * BROKEN_SHARE * len(rest.head) + BROKEN_MORE)))))
    made.append(rest.text(len(rest)).strip())
    return [chunk for chunk in made if len(chunk) >= LEAST_CHUNK]


def chunk_texts(docs: DataFrame, key: str, text: str, most: int, count: Callable[[str], int] | None = None, **options) -> DataFrame:
    """(key, chunk number, chunk)."""
    count = count or (lambda line: len(line.split()))

    @F.pandas_udf("array<string>")
    def chunked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, most, count, **options) if t is not None else [])

    return docs.select(key, F.posexplode(chunked(text)).alias("chunk_no", "chunk"))
