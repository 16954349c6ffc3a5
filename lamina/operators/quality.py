"""Quality of graphs: metrics, audits and gates. A graph that fails is a row with a reason, not an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .edges import HIERARCHY, KNN, RAG


def missing_reverse(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct edges without one in the other direction."""
    one = edges.select(*keys, "src", "dst").distinct()
    return one.join(one.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")), [*keys, "src", "dst"], "left_anti")


def metrics(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """n_nodes, avg_degree and lcc_frac of each graph. nodes: keys, node; edges: keys, src, dst.

    Each end of each directed edge counts to the degree, so one link in both directions adds 2 to both its nodes."""
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    of = components(edges.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")), keys)
    largest = of.groupBy(*keys, "component").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("lcc"))
    both = n.join(e, list(keys), "left").join(largest, list(keys), "left")
    some = F.col("n_edges").isNotNull() & (F.col("n_nodes") > 0)
    return both.select(*keys, "n_nodes", F.when(some, 2.0 * F.col("n_edges") / F.col("n_nodes")).otherwise(0.0).alias("avg_degree"), F.when(some, F.greatest(F.lit(1), F.col("lcc")) / F.col("n_nodes")).otherwise(0.0).alias("lcc_frac"))


def audit(edges: DataFrame, sizes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counts of what a graph's edges must not have, and of its relations. sizes: keys, k_fine, k_med, k_coarse.

    Scales of hierarchy edges are only looked at in graphs without ends out of bounds."""
    n = F.col("k_fine") + F.col("k_med") + F.col("k_coarse")

    def scale(c: str) -> Column:
        return F.when(F.col(c) < F.col("k_fine"), 0).when(F.col(c) < F.col("k_fine") + F.col("k_med"), 1).otherwise(2)

    def outside(c: str) -> Column:
        return ((F.col(c) < 0) | (F.col(c) >= n)).cast("long")

    typed = edges.join(sizes, list(keys)).withColumn("_s", scale("src")).withColumn("_d", scale("dst"))
    gap = F.abs(F.col("_s") - F.col("_d"))
    low = F.least("_s", "_d")
    h = F.col("edge_type") == HIERARCHY
    counts = typed.groupBy(*keys).agg(
        F.sum(outside("src") + outside("dst")).alias("edge_oob_count"), F.count_if(F.col("src") == F.col("dst")).alias("self_loop_count"),
        *[F.count_if(F.col("edge_type") == t).alias(name) for name, t in (("e_rag", RAG), ("e_knn", KNN), ("e_hier", HIERARCHY))],
        F.count_if(h & (gap == 1) & (low == 0)).alias("hier_fine_med"), F.count_if(h & (gap == 1) & (low == 1)).alias("hier_med_coarse"),
        F.count_if(h & (gap == 2)).alias("hier_fine_coarse_invalid"), F.count_if(h & (gap == 0)).alias("hier_same_scale_invalid"),
    )
    rag = edges.where(f"edge_type = {RAG}")
    distinct = rag.select(*keys, "src", "dst").distinct().groupBy(*keys).agg(F.count("*").alias("_n"))
    lone = missing_reverse(rag, keys).groupBy(*keys).agg(F.count("*").alias("_m"))
    out = sizes.select(*keys).join(counts, list(keys), "left").join(distinct, list(keys), "left").join(lone, list(keys), "left")
    whole = F.col("edge_oob_count") == 0
    names = ["edge_oob_count", "self_loop_count", "e_rag", "e_knn", "e_hier"]
    scales = ["hier_fine_med", "hier_med_coarse", "hier_fine_coarse_invalid", "hier_same_scale_invalid"]
    bad = F.col("hier_fine_coarse_invalid") + F.col("hier_same_scale_invalid")
    return out.select(
        *keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in names], *[F.when(whole, F.col(c)).otherwise(0).alias(c) for c in scales],
        F.when(whole & (F.col("e_hier") > 0), bad / F.col("e_hier")).otherwise(0.0).alias("hier_invalid_frac"),
        F.coalesce(F.coalesce("_m", F.lit(0)) / F.col("_n"), F.lit(0.0)).alias("rag_missing_reverse_frac"),
    )


def gate(min_coverage: float = 0.95, min_lcc: float = 0.85, min_degree: float = 2.0) -> Column:
    """The first reason to reject a graph, '' if there is none. Over the columns of metrics() and audit(), and tissue_coverage."""
    return (
        F.when(F.col("tissue_coverage") < min_coverage, "low_tissue_coverage")
        .when(F.col("lcc_frac") < min_lcc, "disconnected_graph")
        .when(F.col("avg_degree") < min_degree, "low_avg_degree")
        .when(F.col("edge_oob_count") > 0, "edge_index_oob")
        .when(F.col("self_loop_count") > 0, "self_loops")
        .when(F.col("hier_fine_coarse_invalid") > 0, "invalid_fine_coarse_hierarchy")
        .when(F.col("hier_same_scale_invalid") > 0, "invalid_same_scale_hierarchy")
        .when(F.col("rag_missing_reverse_frac") > 0, "rag_missing_reverse_edges")
        .otherwise("")
    )
