"""Connected components of an undirected graph, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written


def components(links: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, id, component (the least id reachable) of each end of links (keys, a, b).

    In each round every node points to its least neighbour, or to itself if it is less; pointers are followed to their ends, and
    the graph is contracted to those. What is left has half the nodes at most, so the edges that are joined shrink from round to
    round, whatever the length of paths. Each step is cut from its lineage."""
    ends = links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(ends.distinct(), "edges")
    labels = written(edges.select(*keys, F.col("a").alias("id"), F.col("a").alias("component")).distinct(), "labels")
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        to = written(edges.groupBy(*keys, F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "pointers")
        while True:
            further = to.select(*keys, F.col("id").alias("to"), F.col("to").alias("next"))
            moved = written(to.join(further, [*keys, "to"]).select(*keys, "id", F.col("to").alias("old"), F.col("next").alias("to")), "pointers")
            to = moved.drop("old")
            if moved.where("old <> to").isEmpty():
                break
        at = labels.join(to.withColumnRenamed("id", "component"), [*keys, "component"], "left")
        labels = written(at.select(*keys, "id", F.coalesce("to", "component").alias("component")), "labels")
        a, b = (to.select(*keys, F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        met = edges.join(a, [*keys, "a"]).join(b, [*keys, "b"]).where("to_a <> to_b")
        edges = written(met.select(*keys, F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
    return labels
