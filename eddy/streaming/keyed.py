"""Many online models in one stream, state in tables keyed by (model, mc_id) (STR1, STR2, STR4, STR6, STR8, STR9, STR10).

Points carry a model key; every tick steps all models that the state holds:

* one aggregate per model for counts, scaling sums and boxes (AGG5, AGG10, FLT4);
* one pass over the points: nearest centroid of the own model, in-lier split, outlier cell, summed by
  (model, micro-cluster, cell) with map-side combine. Centroids are broadcast in slices of models of at
  most `MODEL_BYTES`; a slice's pass reads only its models' points;
* the model step, grouped by model: a group holds a model of at most q rows, at most q cells and the
  window's deltas, bounded by the parameters and never by the data, and all models run in parallel.
  Rows come from and go to the state table; the driver sees no model row but the centroids it broadcasts.

State is Parquet under `<path>/state/kind=K/tick=T`; which partitions are live is said by a manifest that
changes by one rename (`sources.manifest`), the commit of a tick:

  model       each model at the end of the tick (window snapshots; pyramidal schedule)
  next        the model that assigns the next tick; only the last one is live
  delta       each tick's contribution by micro-cluster (window, horizon)
  cumulative  everything since the start by lineage root (D9; pyramidal schedule): two of them subtract to
              the exact CF of the ticks between
  meta        per model: total points, next free id

`expire` drops what is older than a window, all kinds, by the same commit. A tick that failed before its
commit is run again and replaces its own partitions; a committed batch id is skipped.

Models whose points did not come stay, their windows move on; a model all of whose clusters expired keeps
its meta row, and its next points start new clusters. Rows with a null model or unusable features are
not clustered; `rejected` selects them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ModelConfig, ensure_checkpoint_dir
from ..operators.assign import MODEL_BYTES, _radius, nearest_center
from ..operators.cf import cf_sum
from ..operators.init import uniform_expr
from ..operators.kdblocks import BLOCK_ROWS, CenterBlocks
from ..operators.pyramid import _powers
from ..sources.manifest import Manifest
from .model_step import STEP_SCHEMA, step_group
from .outliers import LEVELS, cell_sums

PASS_TYPE = T.StructType([T.StructField("mc_id", T.LongType()), T.StructField("cell", T.ArrayType(T.LongType()))])
CENTERS = "model bigint, mc_id bigint, centroid array<double>, rmsd double, n bigint, all_in boolean"


def rejected(points: DataFrame, dims: int) -> DataFrame:
    """Rows of (model, point_id, features) that no model can take."""
    return points.where(~_usable(dims))


def _usable(dims: int):
    f = F.col("features")
    fine = (F.size(f) == dims) & F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col("model").isNotNull() & F.coalesce(fine, F.lit(False))


def make_pass_udf(rows: list, dims: int, t_factor: float):
    """Nearest centroid of the point's own model and, for an outlier, its cell, from (model, mc_id,
    centroid, rmsd, n, all_in) rows."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["model"], []).append(r)
    models = {}
    for key, rs in by.items():
        rs.sort(key=lambda r: r["mc_id"])
        rmsd, n = np.array([r["rmsd"] for r in rs], dtype=np.float64), np.array([r["n"] for r in rs], dtype=np.int64)
        models[key] = (np.array([r["mc_id"] for r in rs], dtype=np.int64),
                       np.array([list(r["centroid"]) for r in rs], dtype=np.float64).reshape(len(rs), dims),
                       _radius(rmsd, n, t_factor), rs[0]["all_in"])
    blocks: dict[int, CenterBlocks] = {}

    @F.pandas_udf(PASS_TYPE)
    def place(model: pd.Series, *cols: pd.Series) -> pd.DataFrame:
        x = np.stack([c.to_numpy(dtype=np.float64) for c in cols], axis=1)
        key = model.to_numpy(dtype=np.int64)
        mc, cells = np.full(len(x), -1, dtype=np.int64), np.empty(len(x), dtype=object)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, edges):
            if not len(part):
                continue
            own, p = models.get(int(key[part[0]])), x[part]
            if own is None:                        # no cluster is left: cells of width 1 from the origin
                out, offset = np.ones(len(part), dtype=bool), p
            else:
                ids, centers, radius, all_in = own
                if len(ids) > BLOCK_ROWS and key[part[0]] not in blocks:
                    blocks[key[part[0]]] = CenterBlocks(centers)
                pos, d2 = nearest_center(list(p.T), centers, blocks.get(key[part[0]]))
                mc[part] = ids[pos]
                out = np.zeros(len(part), dtype=bool) if all_in else ~(np.sqrt(d2) <= radius[pos])
                width = np.where(radius[pos] > 0, radius[pos], 1.0)
                offset = (p - centers[pos]) / width[:, None]
            far = np.floor(offset[out]).clip(-2.0 ** 62, 2.0 ** 62).astype(np.int64)
            cells[part[out]] = [c for c in far]
        return pd.DataFrame({"mc_id": mc, "cell": cells})
    return place


def coarsen(cells: DataFrame, dims: int, q: int) -> DataFrame:
    """Outlier cells of every model summed to at most q of them: per model the least doubling of the width
    that leaves q, else one cell a cluster."""
    down = lambda k: F.transform("cell", lambda x: F.call_function("shiftright", x, k))
    sizes = (cells.select("model", "mc_id", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("k"), "cell")
             .select("model", "k", "mc_id", down(F.col("k")).alias("c")).distinct()
             .groupBy("model", "k").agg(F.count(F.lit(1)).alias("cells"))
             .groupBy("model").agg(F.min(F.when(F.col("cells") <= q, F.col("k"))).alias("k")))
    one = F.transform("cell", lambda x: F.lit(0).cast("bigint"))
    met = cells.join(sizes, "model").withColumn("cell", F.when(F.col("k").isNull(), one).otherwise(down(F.col("k"))))
    sums = met.groupBy("model", "mc_id", "cell").agg(
        F.sum("n").alias("n"), F.min("first_pid").alias("first_pid"),
        *[F.sum(F.col(v)[d]).alias(f"_{v}{d}") for v in ("cf1x", "cf2x") for d in range(dims)])
    return sums.select("model", "mc_id", "cell", "n", "first_pid",
                       *[F.array(*[F.col(f"_{v}{d}") for d in range(dims)]).alias(v) for v in ("cf1x", "cf2x")])


class KeyedModels:
    """Online models by key, under `path`."""

    def __init__(self, spark: SparkSession, cfg: ModelConfig, path: str, model_bytes: int = MODEL_BYTES):
        if cfg.variant != "dynamic" or cfg.init_mode != "random":
            raise ValueError("keyed models start at random and are of the dynamic variant")
        ensure_checkpoint_dir(spark)
        self.spark, self.cfg, self.path, self.model_bytes = spark, cfg, path.rstrip("/"), model_bytes
        self.manifest = Manifest(spark, self.path)

    # ---------------------------------------------------------------- state
    @property
    def tick(self) -> int:
        return int(self.manifest.state["tick"])

    def _folder(self, kind: str, tick: int) -> str:
        return f"{self.path}/state/kind={kind}/tick={tick}"

    def read(self, kind: str, ticks: list[int] | None = None) -> DataFrame:
        """Live partitions of a kind (those of `ticks`), with their tick as `dtick`."""
        live = self.manifest.live(kind)
        some = [t for t in (live if ticks is None else ticks) if t in set(live)]
        if not some:
            return self.spark.createDataFrame([], STEP_SCHEMA)
        return self.spark.read.schema(STEP_SCHEMA).parquet(*[self._folder(kind, t) for t in some])

    def model(self, tick: int | None = None) -> DataFrame:
        return self.read("model", [self.tick if tick is None else tick]).drop("kind", "first_pid")

    def _shape(self, df: DataFrame, kind: str) -> DataFrame:
        have = set(df.columns)
        return df.selectExpr(*[f"'{kind}' AS kind" if f.name == "kind" else
                               f"CAST({f.name if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
                               for f in STEP_SCHEMA.fields])

    def _dropped(self, t: int) -> set[int]:
        """Snapshot ticks that the pyramidal schedule drops when t is written (STR7)."""
        order = 0
        for p in _powers(self.cfg.alpha):
            if t % p:
                break
            order += 1
        return {t - (self.cfg.alpha ** self.cfg.l + 1) * self.cfg.alpha ** (order + 1)}

    # ----------------------------------------------------------------- step
    def _statistics(self, pts: DataFrame) -> DataFrame:
        x = F.col("features")
        return pts.groupBy("model").agg(
            F.count(F.lit(1)).alias("batch_n"),
            *[f(x[d] if p == 1 else x[d] * x[d]).alias(f"{a}{d}") for d in range(self.cfg.dims)
              for f, p, a in ((F.sum, 1, "a"), (F.sum, 2, "b"), (F.min, 1, "lo"), (F.max, 1, "hi"))])

    def _scaled(self, pts: DataFrame, stats: DataFrame) -> DataFrame:
        """PRJ1 per model: sample z-score, 0 in a constant dimension."""
        n, z = F.col("batch_n").cast("double"), []
        for d in range(self.cfg.dims):
            a, b = F.col(f"a{d}"), F.col(f"b{d}")
            var = F.when(F.col("batch_n") > 1, F.greatest((b - a * a / n) / (n - 1), F.lit(0.0))).otherwise(0.0)
            z.append(F.when(var > 0, (F.col("features")[d] - a / n) / F.sqrt(var)).otherwise(0.0))
        keep = ["model", "batch_n"] + [f"{c}{d}" for c in "ab" for d in range(self.cfg.dims)]
        # one row a model: AQE broadcasts it when its measured size is small, else it splits a hot model
        return pts.join(stats.select(*keep), "model").select("model", "point_id", F.array(*z).alias("features"))

    def _starts(self, stats: DataFrame, meta: DataFrame) -> DataFrame:
        """CLU1 for models that are new: q uniform centers in the box (the unit cube when scaled)."""
        cfg = self.cfg
        unit = cfg.scaling == "batch"
        box = [(F.lit(0.0), F.lit(1.0)) if unit else (F.col(f"lo{d}"), F.col(f"hi{d}")) for d in range(cfg.dims)]
        new = stats.join(meta.select("model"), "model", "left_anti")
        ids = new.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cfg.q - 1).cast("bigint"))).alias("mc_id"))
        coords = [lo + uniform_expr(F.col("mc_id"), d, cfg.seed) * (hi - lo) for d, (lo, hi) in enumerate(box)]
        zero = F.array(*[F.lit(0.0)] * cfg.dims)
        none = F.lit(0).cast("bigint")
        return ids.select("model", "mc_id", F.array("mc_id").alias("ids"), none.alias("n"), zero.alias("cf1x"), zero.alias("cf2x"),
                          none.alias("cf1t"), none.alias("cf2t"), F.lit(self.tick + 1).cast("bigint").alias("last_tick"),
                          F.array(*coords).alias("centroid"), F.lit(0.0).alias("rmsd"))

    def _pass(self, pts: DataFrame, centers: DataFrame) -> DataFrame:
        """(model, mc_id, cell, n, first_pid, cf1x, cf2x) of the tick's points."""
        dims = self.cfg.dims
        most = max(1, self.model_bytes // (dims * 8 + 48))
        rows = centers.limit(most + 1).collect()                 # at most `model_bytes`
        slices = 1 if len(rows) <= most else -(-centers.count() // most)
        out = None
        for k in range(slices):
            own = lambda df: df.where(F.pmod(F.xxhash64("model"), F.lit(slices)) == k) if slices > 1 else df
            place = make_pass_udf(own(centers).collect() if slices > 1 else rows, dims, self.cfg.t_factor)
            near = own(pts).withColumn("_a", place("model", *[F.col("features")[d] for d in range(dims)])).select(
                "model", "point_id", "features", "_a.mc_id", "_a.cell")
            out = near if out is None else out.unionByName(near)
        return cell_sums(out, dims, ["model", "mc_id", "cell"])

    def step(self, batch: DataFrame, batch_id: int | None = None) -> bool:
        """One tick of all models from (model, point_id, features); False for an empty or committed batch."""
        cfg, m = self.cfg, self.manifest
        bid = int(m.state["batch_id"]) + 1 if batch_id is None else batch_id
        if bid <= int(m.state["batch_id"]):
            return False
        pts = batch.where(_usable(cfg.dims)).select(F.col("model").cast("bigint").alias("model"),
                                                    F.col("point_id").cast("bigint").alias("point_id"), "features")
        t, prev = self.tick + 1, self.tick
        stats = self._statistics(pts).persist()
        passed = None
        try:
            if stats.isEmpty():
                return False
            meta = self.read("meta", [prev])
            before = self.read("next", [prev])
            starts = self._starts(stats, meta)
            if cfg.scaling == "batch":
                pts = self._scaled(pts, stats)
            cols = ["model", "mc_id", "centroid", "rmsd", "n"]
            centers = before.select(*cols, F.lit(False).alias("all_in")).unionByName(
                starts.select(*cols, F.lit(True).alias("all_in")))
            passed = self._pass(pts, centers).persist()          # one row a cluster or cell: read twice
            sums = passed.withColumn("cf1t", F.col("n") * t).withColumn("cf2t", F.col("n") * (t * t)).withColumn(
                "last_tick", F.lit(t).cast("bigint"))
            cells = passed.where("cell IS NOT NULL")
            crowded = cells.groupBy("model").count().where(F.col("count") > cfg.q)
            if not crowded.isEmpty():
                cells = coarsen(cells, cfg.dims, cfg.q)
            cells = cells.drop("mc_id")
            window = self.read("delta", list(range(max(1, t + 2 - cfg.delta), t))) if cfg.remove_expired else None
            counts = stats.select("model", F.col("batch_n").alias("n"))
            parts = [self._shape(before, "model"), self._shape(starts, "model"), self._shape(sums.where("cell IS NULL").drop("first_pid"), "in"),
                     self._shape(cells, "new"), self._shape(meta, "meta"), self._shape(counts, "count")]
            if window is not None:
                parts.append(self._shape(window, "wd"))
            u = parts[0]
            for p in parts[1:]:
                u = u.unionByName(p)
            out = u.groupBy("model").applyInPandas(self._model_step(t, bid), STEP_SCHEMA)
            (out.withColumn("tick", F.lit(t).cast("bigint")).withColumn("_k", F.col("kind")).drop("kind").withColumnRenamed("_k", "kind")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "tick")
             .parquet(f"{self.path}/state"))
        finally:
            stats.unpersist()
            if passed is not None:
                passed.unpersist()
        self._write_cumulative(t, prev)
        live = {k: list(v) for k, v in m.state["live"].items()}
        bye = self._dropped(t)
        for kind in ("model", "cumulative"):
            live[kind] = [x for x in live.get(kind, []) if x not in bye] + [t]
        live["delta"] = live.get("delta", []) + [t]
        live["next"], live["meta"] = [t], [t]
        m.commit(tick=t, batch_id=bid, live=live)
        return True

    def _model_step(self, t: int, bid: int):
        cfg = self.cfg

        def fn(pdf: pd.DataFrame) -> pd.DataFrame:
            meta, counts = pdf[pdf["kind"] == "meta"], pdf[pdf["kind"] == "count"]
            rows = pdf[~pdf["kind"].isin(["meta", "count"])]
            batch_n = int(counts["n"].sum()) if len(counts) else 0
            new = not len(meta)
            total = batch_n + (0 if new else int(meta["total_n"].iloc[0]))
            next_id = cfg.q if new else int(meta["next_id"].iloc[0])
            if not len(rows):                                    # every cluster has expired
                out = meta.copy()
                out["dtick"], out["batch_id"], out["n"] = t, bid, 0
                return out
            out = step_group(rows, t, next_id, cfg.q, cfg.delta, cfg.remove_expired, cfg.recursive_outliers, all_in=new,
                             total_n=total, batch_id=bid, m_last=cfg.m_last, t_factor=cfg.t_factor)
            last = out["kind"] == "meta"
            out.loc[last, "next_id"] = max(next_id, int(out.loc[last, "next_id"].iloc[0]))
            return out
        return fn

    # ------------------------------------------------- cumulative and horizon
    def _fold(self, rows: DataFrame, tick: int) -> DataFrame:
        """CF rows with `ids`, folded onto the roots of `tick`'s models; rows without a living root keep
        their own id (JOI8, AGG8)."""
        roots = self.spark.read.schema(STEP_SCHEMA).parquet(self._folder("model", tick)).select(
            F.col("model").alias("_m"), F.col("mc_id").alias("_root"), F.explode("ids").alias("_member"))
        met = rows.join(roots, (F.col("model") == F.col("_m")) & (F.col("mc_id") == F.col("_member")), "left").withColumn(
            "mc_id", F.coalesce("_root", "mc_id")).drop("_m", "_root", "_member")
        return cf_sum(met, ["model", "mc_id"], self.cfg.dims, ids=True)

    def _write_cumulative(self, t: int, prev: int) -> None:
        cols = ["model", "mc_id", "ids", "n", "cf1x", "cf2x", "cf1t", "cf2t", "last_tick"]
        delta = self.spark.read.schema(STEP_SCHEMA).parquet(self._folder("delta", t)).select(*cols)
        rows = self._fold(self.read("cumulative", [prev]).select(*cols).unionByName(delta), t)
        self._shape(rows, "cumulative").drop("kind").write.mode("overwrite").parquet(self._folder("cumulative", t))

    def horizon(self, h: int, tc: int | None = None) -> DataFrame:
        """STR9: (model, mc_id, ids, n, cf1x, ...) of the ticks (t2, t1], where t1 and t2 are the last kept
        cumulative snapshots at tc and tc - h: one subtracted from the other, folded by lineage. Clusters
        without points in between have no row."""
        tc = self.tick if tc is None else tc
        kept = self.manifest.live("cumulative")
        t1, t2 = max((x for x in kept if x <= tc), default=None), max((x for x in kept if x <= tc - h), default=None)
        if t1 is None:
            return self.read("cumulative", [])
        cols = ["model", "mc_id", "ids", "n", "cf1x", "cf2x", "cf1t", "cf2t", "last_tick"]
        now = self.read("cumulative", [t1]).select(*cols)
        if t2 is None:
            return now
        minus = lambda c: F.transform(c, lambda x: -x)
        old = self.read("cumulative", [t2]).select("model", F.col("mc_id").alias("_old"), (-F.col("n")).alias("n"), minus("cf1x").alias("cf1x"),
                                                   minus("cf2x").alias("cf2x"), (-F.col("cf1t")).alias("cf1t"), (-F.col("cf2t")).alias("cf2t"),
                                                   F.lit(None).cast("bigint").alias("last_tick"))
        member = now.select(F.col("model").alias("_m"), "mc_id", F.explode("ids").alias("_id"))
        roots = old.join(member, (F.col("model") == F.col("_m")) & (F.col("_old") == F.col("_id"))).select(
            "model", "mc_id", F.array().cast("array<bigint>").alias("ids"), "n", "cf1x", "cf2x", "cf1t", "cf2t", "last_tick")
        return cf_sum(now.unionByName(roots), ["model", "mc_id"], self.cfg.dims, ids=True).where("n > 0")

    def centers(self, h: int, tc: int | None = None) -> DataFrame:
        """STR12 by horizon: (model, mc_id, n, center)."""
        hz = self.horizon(h, tc)
        return hz.select("model", "mc_id", "n", F.transform("cf1x", lambda x: x / F.col("n").cast("double")).alias("center"))

    # ---------------------------------------------------------------- expiry
    def expire(self, window: int) -> list[tuple[str, int]]:
        """STR8: drop every partition of before the last `window` ticks (never those that the next step
        needs), then the folders that no reader can reach any more. Returns what was deleted."""
        first = self.tick - window + 1
        floor = self.tick + 2 - self.cfg.delta if self.cfg.remove_expired else self.tick
        live = {}
        for kind, ticks in self.manifest.state["live"].items():
            least = {"delta": min(first, floor), "next": self.tick, "meta": self.tick}.get(kind, min(first, self.tick))
            live[kind] = [t for t in ticks if t >= least]
        self.manifest.commit(live=live)
        return self.manifest.sweep(f"{self.path}/state")


def replay_keyed(spark: SparkSession, points: DataFrame, cfg: ModelConfig, path: str, expire: int | None = None) -> KeyedModels:
    """The ticks of a table (model, tick, point_id, features) in order; each step's tick filter reaches the
    table's scan. With `expire`, state older than so many ticks goes after each step."""
    models = KeyedModels(spark, cfg, path)
    from ..sources.points import tick_list
    for i, t in enumerate(tick_list(points)):
        models.step(points.where(F.col("tick") == t), i)
        if expire is not None:
            models.expire(expire)
    return models


def run_keyed_stream(spark: SparkSession, stream: DataFrame, cfg: ModelConfig, path: str) -> KeyedModels:
    """A streaming DataFrame (model, point_id, features): a step a micro-batch, to the end of what is there."""
    models = KeyedModels(spark, cfg, path)

    def each(df: DataFrame, batch_id: int) -> None:
        if batch_id <= int(models.manifest.state["batch_id"]):
            return
        rejected(df, cfg.dims).write.mode("overwrite").parquet(f"{path}/quarantine/batch_id={batch_id}")
        models.step(df, batch_id)

    (stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/stream-checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return models
