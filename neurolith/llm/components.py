"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolith.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): every node of an edge with the least node of its component.

    Each round maps every node to the least of its neighbours and itself and contracts the edges; nodes at least halve, so
    rounds grow with the logarithm of a component, whatever its shape. Maps and edges go through the shared folder. Hot
    nodes meet in partial sums and in joins that adaptive execution splits. Null ends and loops are left out.
    """
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while True:
        m = cut(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        if labels is None:
            labels = m.toDF("node", "label")
        else:
            labels = cut(labels.join(m, labels.label == m.a, "left").select("node", F.coalesce("m", "label").alias("label")))
        if m.isEmpty():
            return labels
        e = e.join(m, "a").select(F.col("m").alias("x"), "b").join(m.toDF("b", "y"), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        e = cut(e)
        if e.isEmpty():
            return labels
