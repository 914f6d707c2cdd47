"""Sliding-window model (STR4, WIN1, JOI8, VAR5).

The window state at tick tc is the sum of the tick deltas with
tc - delta < tick <= tc, folded onto the current lineage roots. Because CF
is additive this is exact: no subtraction from live objects, no drift, and
cf1t / cf2t come out right as well. Each delta row is replicated to the
`delta` window ends it belongs to (what a sliding `window()` does) and the
replicas are summed per (tc, root).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cf import cf_sum


def lineage(model: DataFrame) -> DataFrame:
    """(mc_id root, member_id) from a model's ids arrays."""
    return model.select("mc_id", F.explode("ids").alias("member_id"))


def window_state(deltas: DataFrame, delta: int, dims: int, last_tick: int,
                 lineage_map: DataFrame | None = None, ends: list[int] | None = None) -> DataFrame:
    """(tick = window end, mc_id, CF) for every window end up to `last_tick`.

    JOI8: a delta row of member d counts for root m when m.ids contains d.
    `ends` restricts the window ends (e.g. to the snapshot ticks).
    """
    t = F.col("tick")
    span = F.sequence(t, F.least(t + F.lit(delta - 1), F.lit(last_tick)))
    if ends is not None:
        allowed = F.array(*[F.lit(int(e)).cast("bigint") for e in sorted(ends)])
        span = F.filter(span, lambda e: F.array_contains(allowed, e))
    rep = deltas.withColumn("_end", F.explode(span))
    if lineage_map is not None:
        rep = (rep.join(lineage_map.withColumnRenamed("mc_id", "_root"), rep.mc_id == F.col("member_id"))
               .drop("mc_id", "member_id").withColumnRenamed("_root", "mc_id"))
    rep = rep.drop("tick").withColumnRenamed("_end", "tick")
    return cf_sum(rep, ["tick", "mc_id"], dims)


def window_state_at(deltas: DataFrame, tc: int, delta: int, dims: int,
                    lineage_map: DataFrame | None = None) -> DataFrame:
    """STR4 at one tick: only the deltas still inside the window are read."""
    inside = deltas.where((F.col("tick") > F.lit(tc - delta)) & (F.col("tick") <= F.lit(tc)))
    if lineage_map is not None:
        inside = (inside.join(lineage_map.withColumnRenamed("mc_id", "_root"), inside.mc_id == F.col("member_id"))
                  .drop("mc_id", "member_id").withColumnRenamed("_root", "mc_id"))
    return cf_sum(inside.drop("tick"), ["mc_id"], dims)
