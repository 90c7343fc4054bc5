"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanframe.session import durable


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hangs neighbours of every node on the smallest node around it.

    ``larger``: the larger neighbours of a node move; else its smaller ones and itself.
    """
    if larger:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = around.join(low, "u")
    if larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
    return moved.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Node -> smallest node it can reach, for every node that has a link.

    ``links`` has two columns of node ids; direction, repeats and self-links do not matter,
    rows with a null end are ignored. Every round halves the depth of the trees, and each
    round's links are a written table, so lineage stays short and lost executors cost one
    round. Only two numbers of a round reach the driver.
    """
    a, b = links.columns[:2]
    edges = durable(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    )
    before = None
    while True:
        mark = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        ).first()
        if mark == before or not mark.n:
            break
        before = mark
        edges = durable(_stars(_stars(edges, True), False))
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
