"""Connected components by hooking and pointer jumping; each round is a written table in the shared folder.

Edges are kept as (child, parent), parent the smaller. A round gives each child its smallest parent, hooks its other parents
to that one, and replaces parents by theirs. Rows are dealt by child, of which a hub has few, so a hub's links are not
gathered; only the join on the parent meets it, and there Spark splits a skewed side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stepweave.llm.shared import work_dir, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u, v long) -> (node, component): the smallest node that links reach, for each node but these smallest themselves.

    Only one number a round goes to the driver."""
    root = work_dir(edges.sparkSession, "components")
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("child"), F.least("u", "v").alias("parent"))
    for i in range(most_rounds):
        least = F.array_min("parents")
        hooks = F.transform(F.array_remove(F.col("parents"), least), lambda p: F.struct(p.alias("child"), least.alias("parent"), F.lit(True).alias("new")))
        own = F.array(F.struct(F.col("child"), least.alias("parent"), F.lit(False).alias("new")))
        met = now.groupBy("child").agg(F.collect_set("parent").alias("parents")).select(F.explode(F.concat(own, hooks)).alias("e")).select("e.*")
        up = met.select(F.col("child").alias("at"), F.col("parent").alias("above")).groupBy("at").agg(F.min("above").alias("up")).withColumnRenamed("at", "parent")
        jumped = met.join(up, "parent", "left").select("child", F.coalesce("up", "parent").alias("parent"), (F.col("new") | F.col("up").isNotNull()).alias("new"))
        moved = Observation()
        now = written(jumped.observe(moved, F.count_if("new").alias("n")), f"{root}/{i}")
        if not moved.get["n"]:
            return now.select(F.col("child").alias("node"), F.col("parent").alias("component"))
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
