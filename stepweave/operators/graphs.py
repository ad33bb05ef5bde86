"""Graphs of tasks as edge tables: layers of an order, degrees, complement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.sources.places import shared_root, work_dir


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))


def mentioned_or_declared(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Nodes that only one side knows: `side` is edges or declared."""
    seen = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("a", F.lit(1))
    both = seen.join(declared.select("node").distinct().withColumn("b", F.lit(1)), "node", "full")
    return both.where("a is null or b is null").select("node", F.when(F.col("a").isNotNull(), "edges").otherwise("declared").alias("side"))


def complement(nodes: DataFrame, disallowed: DataFrame) -> DataFrame:
    """Ordered pairs of different nodes that are not disallowed. The result is quadratic by its meaning: for small graphs."""
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return a.join(b, F.col("src") != F.col("dst")).join(disallowed, ["src", "dst"], "left_anti")


def layers(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """(node, layer) by repeatedly taking nodes without open predecessors; whether all were taken (no cycle).

    Each round is checkpointed, so plans don't grow with the depth of the graph, and rounds go on until none is free."""
    spark = nodes.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    left, open_edges, path, layer = nodes.select("node").distinct().checkpoint(), edges.select("src", "dst").distinct().checkpoint(), work_dir(spark, "layers"), 0
    while True:
        free = left.join(open_edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(layer)).checkpoint()
        if free.isEmpty():
            break
        free.write.mode("append").parquet(path)
        left = left.join(free, "node", "left_anti").checkpoint()
        open_edges = open_edges.join(free, open_edges.src == free.node, "left_anti").checkpoint()
        layer += 1
    empty = left.limit(0).withColumn("layer", F.lit(0))
    return (spark.read.schema(empty.schema).parquet(path) if layer else empty), left.isEmpty()


def topological(nodes: DataFrame, edges: DataFrame, cycle: str = "empty") -> DataFrame:
    """Nodes with their layer. On a cycle: nothing (`empty`), or what is left at the end (`append`)."""
    done, whole = layers(nodes, edges)
    if whole:
        return done
    if cycle == "empty":
        return done.limit(0)
    rest = nodes.select("node").join(done, "node", "left_anti")
    last = done.agg(F.coalesce(F.max("layer") + 1, F.lit(0)).alias("layer"))
    return done.unionByName(rest.crossJoin(last))  # one row
