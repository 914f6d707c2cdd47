"""Connected components of an edge DataFrame (AGG9, AGG11, SET2).

Min-label propagation with pointer jumping: every round each vertex takes
the smallest label among itself and its neighbours, then jumps to the label
of its label. Rounds are joins and min-aggregates on the edge table; lineage
is cut with a reliable checkpoint each round, and the loop stops when no
label changes. The component id is the smallest member id, so it can never
collide with a real micro-cluster id of another component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import cut_lineage


def undirected(edges: DataFrame, group: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    e = edges.select(*group, F.col(src).alias("a"), F.col(dst).alias("b"))
    return e.unionByName(e.select(*group, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def vertices(edges: DataFrame, group: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """AGG11: distinct endpoints (no positional index needed)."""
    return (edges.select(*group, F.col(src).alias("v"))
            .unionByName(edges.select(*group, F.col(dst).alias("v"))).distinct())


def connected_components(edges: DataFrame, group: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(group..., mc_id, component_id) for every vertex that has an edge.

    One round: label := min(label, neighbours' labels, label of the label).
    The round's output carries a `changed` flag, is checkpointed, and the loop
    stops when a filter finds no changed vertex (no join against the previous
    round).
    """
    und = cut_lineage(undirected(edges, group, src, dst))
    keys = group + ["a"]
    labels = cut_lineage(und.groupBy(*keys).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        nb = (und.join(labels.withColumnRenamed("a", "b").withColumnRenamed("label", "nl"), group + ["b"])
              .groupBy(*keys).agg(F.min("nl").alias("nl")))
        step = labels.join(nb, keys, "left").select(
            *keys, F.col("label").alias("old"), F.least("label", F.coalesce("nl", "label")).alias("label"))
        # pointer jumping: label := label(label)
        jump = step.alias("s").join(
            step.select(*group, F.col("a").alias("_t"), F.col("label").alias("_l2")).alias("t"),
            [F.col(f"s.{g}") == F.col(f"t.{g}") for g in group] + [F.col("s.label") == F.col("t._t")], "left")
        new_label = F.least(F.col("s.label"), F.coalesce(F.col("t._l2"), F.col("s.label")))
        new = cut_lineage(jump.select(*[F.col(f"s.{c}") for c in keys], new_label.alias("label"),
                                      (new_label != F.col("s.old")).alias("changed")))
        labels = new.drop("changed")
        if new.where("changed").limit(1).count() == 0:
            return labels.select(*group, F.col("a").alias("mc_id"), F.col("label").alias("component_id"))
