"""Connected components of an undirected graph given as an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stylomill.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each node is connected to. Nodes are of any ordered type.

    Every round points nodes at the smallest neighbour they know of, so the number of rounds grows with the logarithm
    of the longest path. Group minima are aggregates with a map-side part: a node with a third of all edges is no hot task.
    NULL ends and loops link nothing; a node that has only loops comes out as its own component. An empty table gives no row.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = materialize(e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    cur = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        # large star: neighbours above a node go to the smallest node of its neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and those below it go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        cur = materialize(small, "edges")
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
