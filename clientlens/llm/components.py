"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.session import stage

ROWS_PER_FILE = 500_000


def smallest_reachable(edges: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """(node, root): the smallest node of every component of the edges (u, v).

    Every round each node hooks onto its smallest neighbour, chains are halved until they
    are flat, and edges move up to the roots; at least half of the nodes that still have
    edges drop out. Tables shrink from round to round and are written in as many files as
    their rows ask for.
    """
    left = stage(edges.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")), "edges")
    files = max(1, -(-left.count() // rows_per_file))
    held = lambda table, name: stage(table.coalesce(files), name)
    roots = held(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while left.take(1):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = held(both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("child"), F.least("a", "low").alias("parent")), "parents")
        while True:
            above = parent.select(F.col("child").alias("parent"), F.col("parent").alias("higher"))
            jumped = held(parent.join(above, "parent", "left").select(
                "child", F.coalesce("higher", "parent").alias("parent"), (F.col("higher") < F.col("parent")).alias("moved"),
            ), "parents")
            parent = jumped.select("child", "parent")
            if not jumped.where("moved").take(1):
                break

        def up(table: DataFrame, column: str) -> DataFrame:
            moved = table.join(parent.withColumnRenamed("child", column), column, "left")
            return moved.withColumn(column, F.coalesce("parent", column)).drop("parent")

        roots = held(up(roots, "root"), "roots")
        left = held(up(up(left, "a"), "b").where("a <> b").distinct(), "edges")
    return roots
