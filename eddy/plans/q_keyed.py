"""Registered queries of the keyed online models: the events stream with one model an event type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModelConfig, work_dir
from ..sources.points import events_points
from ..streaming.keyed import KeyedModels, replay_keyed
from . import inputs as I
from .catalog import _with, register

KEYED_CFG = ModelConfig(q=12, dims=I.EV_DIMS, delta=I.EV_DELTA, m_last=20, scaling="none", init_mode="random",
                        alpha=I.ALPHA, l=1, seed=I.SEED)
KEYED_H = 2
DAYS = 5                                     # days a tick
TYPES = ["click", "view", "purchase"]       # the others share a model


def keyed_points(spark, sf_dir: str) -> DataFrame:
    """Events points, five days a tick, with the model key of their type: 0 for any type without one of its own."""
    key = F.lit(0)
    for k, name in enumerate(TYPES):
        key = F.when(F.col("event_type") == name, k + 1).otherwise(key)
    return events_points(spark, sf_dir, with_type=True).withColumn(
        "model", key.cast("bigint")).withColumn("tick", F.expr(f"(tick - 1) div {DAYS} + 1")).drop("event_type")


def _run(spark, sf_dir: str, expire: int | None = None) -> KeyedModels:
    return replay_keyed(spark, keyed_points(spark, sf_dir), KEYED_CFG, work_dir(spark, "keyed"), expire)


@register("keyed_replay")
def q_keyed_replay(spark, sf_dir):
    """STR1/STR2/STR4/STR6/STR10 by key: the events stream through one model an event type; the last window
    models. (Tests hold each against a loop of its own.)"""
    m = _run(spark, sf_dir).model()
    ids = F.concat_ws(",", F.transform(F.array_sort("ids"), lambda x: x.cast("string")))
    return m.select("model", "mc_id", "n", *I.flat(m, "centroid", I.EV_DIMS), "rmsd", "cf1t", "cf2t", "last_tick", ids.alias("ids"))


_MODEL = "CASE " + " ".join(f"WHEN event_type = '{t}' THEN {k + 1}" for k, t in enumerate(TYPES)) + " ELSE 0 END"


@register("keyed_horizon", _with(I.EV_POINTS_SQL, f"""kp AS (SELECT * REPLACE (CAST((tick - 1) // {DAYS} + 1 AS BIGINT) AS tick) FROM ev_pts),
t AS (SELECT max(tick) AS t1 FROM kp),
kept AS (
  SELECT r.tick FROM (SELECT DISTINCT tick FROM kp) r, t
  WHERE r.tick + {I.ALPHA + 1} * power({I.ALPHA}, 1 + CAST((SELECT count(*) FROM range(1, 40) p
    WHERE r.tick % CAST(power({I.ALPHA}, p.range) AS BIGINT) = 0) AS BIGINT)) > t.t1),
b AS (SELECT coalesce(max(kept.tick), 0) AS t2 FROM kept, t WHERE kept.tick <= t.t1 - {KEYED_H})""")
          + f"""SELECT CAST({_MODEL} AS BIGINT) AS model, b.t2, count(*) AS n, sum(x0) AS cf1x_0, sum(x1) AS cf1x_1, sum(x0 * x0) AS cf2x_0,
       sum(x1 * x1) AS cf2x_1, CAST(sum(tick) AS BIGINT) AS cf1t, CAST(sum(tick * tick) AS BIGINT) AS cf2t
FROM kp, b WHERE tick > b.t2 GROUP BY 1, 2""")
def q_keyed_horizon(spark, sf_dir):
    """STR9/D9, STR7, STR8: cumulative snapshots of the loop, old state dropped after each tick, subtracted
    for the last ticks. Summed by model, the micro-clusters must hold every point since the older one."""
    models = _run(spark, sf_dir, expire=100)
    t2 = max((x for x in models.manifest.live("cumulative") if x <= models.tick - KEYED_H), default=0)
    hz = models.horizon(KEYED_H)
    return hz.groupBy("model").agg(
        F.lit(t2).cast("bigint").alias("t2"), F.sum("n").alias("n"),
        *[F.sum(F.col(c)[d]).alias(f"{c}_{d}") for c in ("cf1x", "cf2x") for d in range(I.EV_DIMS)],
        F.sum("cf1t").alias("cf1t"), F.sum("cf2t").alias("cf2t"))
