"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of the edges (a, b): root is the least id of its component.

    Each round takes the least root among a node's neighbours, hands it to the node's own root, and
    lets every node follow its root one step. The rounds grow with the logarithm of a component's
    diameter. Nodes and edges stay rows throughout; hubs are pre-aggregated before each shuffle.

    Cases: without edges the result is empty; loops and repeated edges change nothing.
    """
    pairs = edges.select("a", "b")
    both = stored(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("met"))
        met = labels.join(seen, labels["id"] == seen["a"]).select("id", "root", F.least("root", "met").alias("met"))
        moved = met.groupBy("root").agg(F.min("met").alias("to")).withColumnRenamed("root", "of")
        hooked = met.join(moved, met["root"] == moved["of"]).select("id", F.col("root").alias("was"), "to")
        step = labels.select(F.col("id").alias("at"), F.col("root").alias("next"))
        found = hooked.join(step, hooked["to"] == step["at"], "left").select("id", "was", F.least("to", F.coalesce("next", "to")).alias("root"))
        found = stored(found, "labels")
        labels = found.select("id", "root")
        if found.where("root != was").isEmpty():
            return labels
