"""Pyramidal time frame and snapshot algebra (STR7, STR8, STR9, JOI7, JOI9, SET1).

Snapshot order of tick t: the largest i with alpha^i | t (integer valuation,
no floating log). Snapshot t is written at t and deleted at the first tick T
with T >= t + (alpha^l + 1) * alpha^(order(t) + 1), so at time T it is
retained iff t + (alpha^l + 1) * alpha^(order(t) + 1) > T.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


MAX_POWER = 2 ** 62


def _powers(alpha: int) -> list[int]:
    out, p = [], alpha
    while p <= MAX_POWER:
        out.append(p)
        p *= alpha
    return out


def snapshot_order(tick, alpha: int) -> F.Column:
    """Integer valuation of `tick` in base alpha (0 when alpha does not divide it)."""
    t = F.col(tick) if isinstance(tick, str) else tick
    powers = F.array(*[F.lit(p).cast("bigint") for p in _powers(alpha)])
    return F.size(F.filter(powers, lambda p: t % p == 0)).cast("bigint")


def retention_span(order: F.Column, alpha: int, l: int) -> F.Column:
    """(alpha^l + 1) * alpha^(order + 1), capped to avoid overflow."""
    pw = F.aggregate(F.sequence(F.lit(0).cast("bigint"), order), F.lit(1).cast("bigint"),
                     lambda acc, _: F.least(acc * F.lit(alpha), F.lit(MAX_POWER)))
    return F.least(F.lit(alpha ** l + 1).cast("bigint") * pw, F.lit(MAX_POWER))


def retained(ticks: DataFrame, now, alpha: int, l: int, tick: str = "tick") -> DataFrame:
    """STR7: snapshot ticks (<= now) still kept at time `now`, with their order."""
    now_c = now if isinstance(now, F.Column) else F.lit(now)
    o = snapshot_order(tick, alpha)
    return (ticks.where(F.col(tick) <= now_c)
            .withColumn("snap_order", o)
            .where(F.col(tick) + retention_span(F.col("snap_order"), alpha, l) > now_c))


def expired(snap_ticks: DataFrame, now, window: int, tick: str = "tick") -> DataFrame:
    """STR8, set-wise: every snapshot older than the window (t < now - window + 1)."""
    now_c = now if isinstance(now, F.Column) else F.lit(now)
    return snap_ticks.where(F.col(tick) < now_c - F.lit(window - 1))


def asof(requests: DataFrame, saved: DataFrame, req_col: str, out: str, tick: str = "tick") -> DataFrame:
    """Latest saved tick <= each request value (NULL if none).

    Both inputs are tick lists (bounded by the number of ticks): the union is
    ordered once and `last(ignorenulls)` carries the latest saved tick
    forward; saved rows sort before requests of the same value.
    """
    r = requests.select(F.col(req_col).alias("_k"), F.lit(None).cast("bigint").alias("_s"),
                        F.lit(1).alias("_r"), *[F.col(c) for c in requests.columns])
    s = saved.select(F.col(tick).alias("_k"), F.col(tick).cast("bigint").alias("_s"), F.lit(0).alias("_r"),
                     *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in requests.columns])
    w = Window.orderBy("_k", "_r").rowsBetween(Window.unboundedPreceding, 0)
    u = r.unionByName(s).withColumn(out, F.last("_s", ignorenulls=True).over(w))
    return u.where(F.col("_r") == 1).drop("_k", "_s", "_r")


def snapshot_pair(requests: DataFrame, saved: DataFrame, h: int, tc: str = "tc", tick: str = "tick") -> DataFrame:
    """JOI9: t1 = latest saved <= tc; t2 = latest saved <= t1 - h, else the
    earliest saved; both NULL when nothing is saved (no endless probe)."""
    a = asof(requests, saved, tc, "t1", tick)
    b = asof(a.withColumn("_probe", F.col("t1") - F.lit(h)), saved, "_probe", "t2", tick).drop("_probe")
    first = saved.agg(F.min(tick)).first()[0]       # scalar of a bounded tick list
    return b.withColumn("t2", F.when(F.col("t1").isNull(), F.lit(None).cast("bigint"))
                        .otherwise(F.coalesce(F.col("t2"), F.lit(first).cast("bigint"))))


def snapshots_at(deltas: DataFrame, snap_ticks: list[int], dims: int, keys: list[str] | None = None) -> DataFrame:
    """Cumulative model at each listed snapshot tick (kind='cumulative').

    Running sums per micro-cluster over its delta rows (one row per tick it was
    touched, so a partition never exceeds the number of ticks); a running row
    at tick t stands for every snapshot tick in [t, next touched tick), and is
    emitted once per such snapshot. Output = snapshots x clusters, nothing more.
    The tick list is small (O(alpha^l log T)) and travels as a literal.
    """
    keys = keys or ["mc_id"]
    arr = F.array(*[F.lit(int(t)).cast("bigint") for t in sorted(snap_ticks)])
    w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.lead("tick").over(Window.partitionBy(*keys).orderBy("tick"))
    run = deltas.select(
        *keys, "tick",
        F.sum("n").over(w).alias("n"),
        *[F.sum(F.col("cf1x")[i]).over(w).alias(f"_s1_{i}") for i in range(dims)],
        *[F.sum(F.col("cf2x")[i]).over(w).alias(f"_s2_{i}") for i in range(dims)],
        F.sum("cf1t").over(w).alias("cf1t"), F.sum("cf2t").over(w).alias("cf2t"),
        F.max("last_tick").over(w).alias("last_tick"),
        nxt.alias("_next"))
    cover = F.filter(arr, lambda s: (s >= F.col("tick")) & (F.col("_next").isNull() | (s < F.col("_next"))))
    out = run.withColumn("_snap", F.explode(cover))
    ids = F.array(*[F.col(k).cast("bigint") for k in keys[-1:]])
    return out.select(F.col("_snap").alias("tick"), *keys, "n",
                      F.array(*[F.col(f"_s1_{i}") for i in range(dims)]).alias("cf1x"),
                      F.array(*[F.col(f"_s2_{i}") for i in range(dims)]).alias("cf2x"),
                      "cf1t", "cf2t", "last_tick", ids.alias("ids"))


def lineage_pairs(snap1: DataFrame, snap2: DataFrame) -> DataFrame:
    """JOI7: (mc1, mc2) whose id sets intersect, via explode + equi-join
    (no nested loop over clusters)."""
    a = snap1.select(F.col("mc_id").alias("mc1"), F.explode("ids").alias("member"))
    b = snap2.select(F.col("mc_id").alias("mc2"), F.explode("ids").alias("member"))
    return a.join(b, "member").select("mc1", "mc2").distinct()


def horizon(snap1: DataFrame, snap2: DataFrame, t1: int, t2: int, h: int, dims: int) -> DataFrame:
    """STR9: the model of the last h ticks = snapshot t1 minus its lineage in t2.

    For each t1 cluster, the related t2 clusters (JOI7) are visited in mc_id
    order and each is subtracted when n stays >= 0 afterwards (the sequential
    rule), as one higher-order `aggregate` over the cluster's sorted relation
    array (bounded by its lineage), JVM-side. No subtraction when t1 - h < t2.
    ids keep their value; new_ids is the set difference (SET1).
    """
    if t1 - h < t2:
        return snap1.withColumn("new_ids", F.col("ids"))
    pairs = lineage_pairs(snap1, snap2)
    s2 = snap2.select(F.col("mc_id").alias("mc2"), F.col("n").alias("n2"), F.col("cf1x").alias("x1"),
                      F.col("cf2x").alias("x2"), F.col("cf1t").alias("t1s"), F.col("cf2t").alias("t2s"),
                      F.col("ids").alias("ids2"))
    rel = (pairs.join(s2, "mc2")
           .groupBy("mc1").agg(F.array_sort(F.collect_list(
               F.struct("mc2", "n2", "x1", "x2", "t1s", "t2s", "ids2"))).alias("rel")))
    j = snap1.join(rel, snap1.mc_id == rel.mc1, "left").withColumn(
        "rel", F.coalesce(F.col("rel"), F.filter(F.array(), lambda r: F.lit(False)).cast(rel.schema["rel"].dataType)))
    none = F.filter("rel", lambda r: F.lit(False))                      # empty, typed
    start = F.struct(F.col("n").alias("rem"), none.alias("picked"))
    acc = F.aggregate("rel", start, lambda a, r: F.when(
        a["rem"] - r["n2"] >= 0,
        F.struct((a["rem"] - r["n2"]).alias("rem"), F.concat(a["picked"], F.array(r)).alias("picked"))
    ).otherwise(a))
    j = j.withColumn("_picked", acc["picked"])
    p = F.col("_picked")
    zero = F.array(*[F.lit(0.0)] * dims)

    def vsum(field):
        return F.aggregate(p, zero, lambda a, r: F.zip_with(a, r[field], lambda u, v: u + v))

    def lsum(field):
        return F.aggregate(p, F.lit(0).cast("bigint"), lambda a, r: a + r[field])

    hit = F.size(p) > 0
    ids2 = F.flatten(F.transform(p, lambda r: r["ids2"]))
    return j.select(
        "mc_id",
        (F.col("n") - lsum("n2")).alias("n"),
        F.when(hit, F.zip_with("cf1x", vsum("x1"), lambda u, v: u - v)).otherwise(F.col("cf1x")).alias("cf1x"),
        F.when(hit, F.zip_with("cf2x", vsum("x2"), lambda u, v: u - v)).otherwise(F.col("cf2x")).alias("cf2x"),
        (F.col("cf1t") - lsum("t1s")).alias("cf1t"),
        (F.col("cf2t") - lsum("t2s")).alias("cf2t"),
        "last_tick", "ids",
        F.when(hit, F.array_except("ids", ids2)).otherwise(F.col("ids")).alias("new_ids"))
