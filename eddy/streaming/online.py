"""Online micro-cluster model: one step per non-empty batch (STR1, STR2, STR3,
STR11), driven by a batch replay of a table or by Structured Streaming.

Per tick the data-sized work is two passes over the batch: the statistics, and
assign + split (Arrow UDF with the model, at most q rows) into one aggregate
with map-side combine, in-lier sums per micro-cluster and outlier sums per cell
(`outliers`). Only CF rows reach the model step, which runs as one
`applyInPandas` group per model over at most 2q rows and the window's deltas
(the unbounded model: its clusters and finest cells).

State lives in one Parquet table partitioned by (kind, tick):
  kind=model  the model at the end of each tick (the snapshots; thinned on the
              pyramidal schedule)
  kind=next   the model after expiry, which assigns the next tick
  kind=delta  each tick's contribution per micro-cluster id (window + horizon)
  kind=skm    centers and weights of a streaming k-means init that is under way
  kind=meta   tick, total points, next free id and the committed batch id
A tick's partitions are written with dynamic overwrite, and the meta row in a
second write after them, so a retried batch rewrites exactly its own
partitions, a torn tick has no meta row and is run again, and a finished batch
is skipped: the loop survives executor loss and driver restarts.
"""

from __future__ import annotations

import collections
import dataclasses
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ModelConfig, ensure_checkpoint_dir
from ..operators.assign import assign_nearest
from ..operators.cf import cf_aggregate
from ..operators.init import bounding_box, random_centers, unit_centers
from ..operators.pyramid import _powers
from ..sources import fs
from .model_step import STEP_SCHEMA, step_group
from .outliers import point_pass, step_rows

META_SCHEMA = T.StructType([
    T.StructField("total_n", T.LongType()),
    T.StructField("next_id", T.LongType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("initialized", T.BooleanType()),
])


def _scale_aggs(dims: int) -> list:
    aggs = [F.count(F.lit(1)).alias("n")]
    for d in range(dims):
        x = F.col("features")[d]
        aggs += [F.sum(x).alias(f"a{d}"), F.sum(x * x).alias(f"b{d}")]
    return aggs


def tick_sums(points: DataFrame, dims: int) -> dict:
    """Count and exact sums per tick for a whole replay in one aggregate (one
    row per tick, bounded like the tick list)."""
    from ..sources.points import MAX_TICKS
    rows = points.groupBy("tick").agg(*_scale_aggs(dims)).limit(MAX_TICKS + 1).collect()
    if len(rows) > MAX_TICKS:
        raise ValueError(f"more than {MAX_TICKS} ticks")
    return {int(r["tick"]): r for r in rows}


def batch_scale(pts: DataFrame, dims: int, row=None):
    """Count and per-dimension z-score of one batch, from exact sums in one
    aggregate (or the precomputed row); returns (n, column expression).
    Sample std; 0 when constant."""
    if row is None:
        row = pts.agg(*_scale_aggs(dims)).first()
    n = int(row["n"])
    if n == 0:
        return 0, None
    z = []
    for d in range(dims):
        a, b = float(row[f"a{d}"]), float(row[f"b{d}"])
        mean = a / n
        std = (max((b - a * a / n) / (n - 1), 0.0) ** 0.5) if n > 1 else 0.0
        x = F.col("features")[d]
        z.append((x - F.lit(mean)) / F.lit(std) if std > 0 else F.lit(0.0))
    return n, F.array(*z)


def usable(features: str, dims: int):
    """Whether a point has `dims` finite components (D17)."""
    f = F.col(features)
    return F.coalesce((F.size(f) == dims) & F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))),
                      F.lit(False))


def snapshot_order_int(t: int, alpha: int) -> int:
    o = 0
    for p in _powers(alpha):
        if t % p:
            break
        o += 1
    return o


def dropped_snapshot(t: int, alpha: int, l: int) -> int | None:
    """The snapshot tick deleted when tick t is written (None if none)."""
    bye = t - (alpha ** l + 1) * alpha ** (snapshot_order_int(t, alpha) + 1)
    return bye if bye > 0 else None


@dataclasses.dataclass
class TickReport:
    tick: int
    batch_n: int
    total_n: int
    clusters: int
    seconds: float
    outliers: int = 0


class OnlineModel:
    """An online micro-cluster model kept as a table under `path`."""

    def __init__(self, spark: SparkSession, cfg: ModelConfig, path: str, model_key: int = 0,
                 unbounded: bool = False):
        ensure_checkpoint_dir(spark)
        self.spark, self.cfg, self.path, self.key = spark, cfg, path.rstrip("/"), model_key
        self.unbounded = unbounded
        self.tick, self.total, self.next_id, self.batch_id = 0, 0, 0, -1
        self.initialized = False
        self.reports: collections.deque[TickReport] = collections.deque(maxlen=1024)   # a log of the last ticks
        self._skm = None          # streaming k-means init state (k x dims, bounded)
        self._next = None         # collected next-tick model (at most q rows)
        self._recent: dict[int, list] = {}   # delta rows of the ticks still in the window
        self._writer = ThreadPoolExecutor(max_workers=1)
        self._pending = None
        self.model_size = 0
        self.outliers = 0
        self._resume()

    # ------------------------------------------------------------ state I/O
    @property
    def state_path(self) -> str:
        return f"{self.path}/state"

    def _exists(self) -> bool:
        return fs.exists(self.spark, f"{self.state_path}/kind=meta")

    def _drop_partition(self, kind: str, tick: int) -> None:
        fs.delete(self.spark, f"{self.state_path}/kind={kind}/tick={tick}")

    def _part_exists(self, kind: str, tick: int) -> bool:
        return fs.exists(self.spark, f"{self.state_path}/kind={kind}/tick={tick}")

    def read(self, kind: str, ticks=None) -> DataFrame:
        """Partition read by path (no listing of the whole state table)."""
        self.flush()
        if ticks is None:
            df = self.spark.read.option("basePath", self.state_path).parquet(f"{self.state_path}/kind={kind}")
        else:
            paths = [f"{self.state_path}/kind={kind}/tick={int(t)}" for t in ticks if self._part_exists(kind, int(t))]
            if not paths:
                return self.spark.createDataFrame([], STEP_SCHEMA).withColumn("tick", F.lit(None).cast("bigint"))
            df = self.spark.read.option("basePath", self.state_path).parquet(*paths)
        return df.withColumn("tick", F.col("tick").cast("bigint")).drop("kind").withColumn("kind", F.lit(kind))

    def _resume(self) -> None:
        if not self._exists():
            return
        meta = self.read("meta").where(F.col("model") == self.key).orderBy(F.col("tick").desc()).first()
        if meta is None:
            return
        self.tick, self.total = int(meta["tick"]), int(meta["total_n"])
        self.next_id, self.batch_id = int(meta["next_id"]), int(meta["batch_id"])
        self.initialized = bool(meta["initialized"])

    def _write_and_release(self, out: DataFrame, t: int) -> None:
        try:
            self._write(out.where(F.col("kind") != "meta"), t)
            self._write(out.where(F.col("kind") == "meta"), t)     # commits the tick
        finally:
            out.unpersist()

    def flush(self) -> None:
        """Wait for the pending tick write (re-raises its failure)."""
        if self._pending is not None:
            pending, self._pending = self._pending, None
            pending.result()

    def _write(self, rows: DataFrame, t: int) -> None:
        (rows.withColumn("tick", F.lit(t).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("kind", "tick").parquet(self.state_path))

    def _commit(self, t: int, batch_id: int) -> None:
        self.flush()
        row = {f.name: None for f in STEP_SCHEMA.fields}
        row.update(kind="meta", model=self.key, dtick=t, total_n=self.total, next_id=self.next_id,
                   batch_id=batch_id, initialized=self.initialized)
        meta = self.spark.createDataFrame([tuple(row[f.name] for f in STEP_SCHEMA.fields)], STEP_SCHEMA)
        self._write(meta, t)   # commit marker of a tick without a model step
        self.batch_id = batch_id

    def _retain(self, t: int) -> None:
        # partitions dropped here belong to ticks whose writes have finished
        # (each write waits for the previous one)
        # pyramidal retention of the model snapshots (STR7) and old 'next' models
        bye = dropped_snapshot(t, self.cfg.alpha, self.cfg.l)
        if bye is not None:
            self._drop_partition("model", bye)
        if t > 2:
            self._drop_partition("next", t - 2)

    def model(self, tick: int | None = None) -> DataFrame:
        t = self.tick if tick is None else tick
        return self.read("model", [t]).drop("kind", "first_pid", "dtick")

    def snapshot_ticks(self) -> list[int]:
        """Ticks whose model snapshot is still kept (pyramidal schedule)."""
        from ..sources.points import tick_list
        return tick_list(self.read("model"))

    def report(self) -> DataFrame:
        """SRC10 over the kept snapshots: one line per micro-cluster and the
        total n of its snapshot."""
        from ..sources.snapshots import report
        return report(self.read("model").drop("kind"))

    def deltas(self, ticks=None) -> DataFrame:
        return self.read("delta", ticks).drop("kind", "first_pid", "centroid", "rmsd", "dtick", "total_n",
                                              "next_id", "batch_id", "initialized")

    def horizon(self, h: int, tc: int | None = None) -> DataFrame:
        """STR9 on the online state, exactly: the CF of ticks (tc - h, tc] folded
        onto the lineage roots of the model at tc (partition-pruned delta read,
        explode of ids, equi-join, one aggregate)."""
        from ..operators.cf import cf_sum
        from ..operators.window import lineage
        tc = self.tick if tc is None else tc
        gone = [t for t in range(max(1, tc - h + 1), tc + 1) if not self._part_exists("delta", t) and not self._part_exists("meta", t)]
        if gone:
            raise ValueError(f"ticks without state: {gone}")
        d = self.deltas(list(range(max(1, tc - h + 1), tc + 1)))
        roots = lineage(self.read("model", [tc]))
        j = d.join(roots.withColumnRenamed("mc_id", "root"), d.mc_id == F.col("member_id"))
        return cf_sum(j.drop("mc_id", "member_id", "tick").withColumnRenamed("root", "mc_id"), ["mc_id"],
                      self.cfg.dims)

    # ----------------------------------------------------------------- step
    def _as_step(self, df: DataFrame, kind: str) -> DataFrame:
        cols = []
        for f in STEP_SCHEMA.fields:
            if f.name == "kind":
                cols.append(F.lit(kind).alias("kind"))
            elif f.name == "model":
                cols.append(F.lit(self.key).cast("bigint").alias("model"))
            elif f.name in df.columns:
                cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
            else:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        return df.select(*cols)

    def _pass(self, pts: DataFrame, rows: list[tuple], t: int, all_in: bool = False) -> list[DataFrame]:
        """The point pass against the clusters `rows` (mc_id, centroid, rmsd, n), as model-step rows.
        Its result (at most q in-lier rows and one row a cell) is cached: the cells are counted
        before they are summed."""
        cfg = self.cfg
        model = {"ids": np.array([r[0] for r in rows], dtype=np.int64),
                 "centers": np.array([list(r[1]) for r in rows], dtype=np.float64).reshape(len(rows), cfg.dims),
                 "rmsd": np.array([r[2] for r in rows], dtype=np.float64),
                 "n": np.array([r[3] for r in rows], dtype=np.int64)}
        centers = self.spark.createDataFrame([(int(r[0]), [float(x) for x in r[1]]) for r in rows],
                                             "mc_id bigint, centroid array<double>")
        self._passed = point_pass(pts, centers, model, cfg.dims, cfg.t_factor, all_in, cfg.variant).persist()
        return step_rows(self._passed, cfg.dims, None if self.unbounded else cfg.q, t, self.key, STEP_SCHEMA)

    def _run_group(self, parts: list[DataFrame], t: int, n: int, batch_id: int, all_in: bool = False) -> None:
        """Model step + one write of the whole tick (model, next, delta and the
        commit row): dynamic overwrite commits the tick's partitions together."""
        cfg, nid = self.cfg, self.next_id
        unbounded, total = self.unbounded, self.total + n

        def fn(pdf):
            return step_group(pdf, t, nid, cfg.q, cfg.delta, cfg.remove_expired, cfg.recursive_outliers,
                              unbounded=unbounded, all_in=all_in, total_n=total, batch_id=batch_id,
                              variant=cfg.variant, m_last=cfg.m_last, t_factor=cfg.t_factor)

        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        # one OnlineModel is one model group: one partition, whatever the
        # session's shuffle partitions (a cached plan is not coalesced by AQE)
        out = u.repartition(1, "model").groupBy("model").applyInPandas(fn, STEP_SCHEMA).persist()
        try:
            rows = out.where(F.col("kind").isin("next", "meta", "delta")).collect()   # model-sized
            size = out.where(F.col("kind") == "model").count()
        except Exception:
            out.unpersist()
            raise
        finally:
            if getattr(self, "_passed", None) is not None:
                self._passed.unpersist()     # `out` is cached now; the point pass output is not needed
                self._passed = None
        # the next tick needs only these rows: the write of this tick overlaps
        # the next tick's point pass (one writer, commits stay in tick order)
        self.flush()
        self._pending = self._writer.submit(self._write_and_release, out, t)
        self._next = sorted((r for r in rows if r["kind"] == "next"), key=lambda r: r["mc_id"])
        # deltas of the ticks that stay in the next window, kept for the next step
        self._recent[t] = [r for r in rows if r["kind"] == "delta"]
        for old_t in [k for k in self._recent if k <= t + 1 - cfg.delta]:
            del self._recent[old_t]
        meta = [r for r in rows if r["kind"] == "meta"]
        self.next_id = max([self.next_id] + [int(r["next_id"]) for r in meta])
        self.outliers = sum(int(r["n"] or 0) for r in meta)
        self.model_size = size
        self.committed = True

    def step(self, batch: DataFrame, batch_id: int | None = None, sums=None) -> TickReport | None:
        """Process one batch of (point_id, features). Empty batches give no tick.
        `sums` is the batch's precomputed count/sums row (replay), else one
        aggregate over the batch computes it."""
        cfg = self.cfg
        if batch_id is not None and batch_id <= self.batch_id:
            return None                                   # already committed
        t0 = time.time()
        pts = batch.where(usable("features", cfg.dims)).select(F.col("point_id").cast("bigint").alias("point_id"), "features")
        n, scale = batch_scale(pts, cfg.dims, sums)    # FLT4 guard + PRJ1 statistics
        if n == 0:
            return None
        t = self.tick + 1
        pts = pts.withColumn("tick", F.lit(t).cast("bigint"))
        if cfg.scaling == "batch":
            pts = pts.withColumn("features", scale)
        # no cache of the whole tick: the statistics pass and the point pass are
        # two column-pruned scans, cheaper at scale than materialising the batch
        bid = batch_id if batch_id is not None else self.batch_id + 1
        self.committed, self.outliers = False, 0
        if not self.initialized:
            self._init_step(pts, t, n, bid)
        else:
            self._online_step(pts, t, n, bid)
        self.tick = t
        self.total += n
        if not self.committed:                      # init still buffering: commit row alone
            self._commit(t, bid)
        else:
            self.batch_id = bid
        self._retain(t)
        clusters = self.model_size if self.initialized else 0
        rep = TickReport(t, n, self.total, clusters, time.time() - t0, self.outliers)
        self.reports.append(rep)
        return rep

    def _load_next(self, t: int) -> None:
        """Collect the next-tick model (at most q rows) once per tick."""
        self._next = self.read("next", [t]).drop("kind", "tick").orderBy("mc_id").collect()
        ids = [i for r in self._next for i in r["ids"]]
        self.next_id = max([self.next_id] + [i + 1 for i in ids])

    def _online_step(self, pts: DataFrame, t: int, n: int, bid: int) -> None:
        cfg = self.cfg
        lo = max(1, t + 2 - cfg.delta)              # window of the next tick: (t+1-delta, t]
        if self._next is None:                      # after a restart: reload from the table
            self._load_next(t - 1)
            for k in range(lo, t):
                self._recent[k] = self.read("delta", [k]).select(*STEP_SCHEMA.names).collect()
        passed = self._pass(pts, [(r["mc_id"], r["centroid"], r["rmsd"], r["n"]) for r in self._next], t)
        # the previous model and the window deltas are model-sized: shipped from
        # the rows collected at the end of the last tick, not re-listed on disk
        nxt = self.spark.createDataFrame(self._next, STEP_SCHEMA)
        parts = [self._as_step(nxt, "model"), *passed]
        if cfg.remove_expired and cfg.delta > 2:
            wd_rows = [r for k in range(lo, t) for r in self._recent.get(k, [])]
            wd = self.spark.createDataFrame(wd_rows, STEP_SCHEMA)      # dtick = the delta's tick
            parts.append(self._as_step(wd, "wd"))
        self._run_group(parts, t, n, bid)

    # ----------------------------------------------------------------- init
    def _init_step(self, pts: DataFrame, t: int, n: int, bid: int) -> None:
        cfg = self.cfg
        if self.unbounded:
            # VAR4: the unbounded model starts empty; the first batch is all outliers
            empty = self.spark.createDataFrame([], "mc_id bigint, centroid array<double>")
            self.initialized = True
            self._next = []
            self._run_group([self._as_step(empty, "model"), *self._pass(pts, [], t)], t, n, bid)
            return
        if cfg.init_mode == "random" or cfg.min_init_points == 0:
            if cfg.scaling == "batch":       # standardised data: the unit cube, as the reference
                centers = unit_centers(self.spark, cfg.q, cfg.dims, cfg.seed)
            else:
                centers = random_centers(self.spark, cfg.q, bounding_box(pts, cfg.dims), cfg.seed)
            self._init_with(centers, pts, t, n, bid)
        elif cfg.init_mode == "kmeans":
            self._buffer(pts, t)
            if self.total + n >= cfg.min_init_points:
                buf = self.read("buffer").drop("kind")
                centers = self._kmeans_centers(buf)
                self._init_with(centers, buf.withColumn("tick", F.lit(t).cast("bigint")), t, n, bid)
        else:
            self._streaming_init(pts, t, n, bid)

    def _buffer(self, pts: DataFrame, t: int) -> None:
        (pts.select("point_id", "features").withColumn("kind", F.lit("buffer")).withColumn("tick", F.lit(t))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("kind", "tick").parquet(self.state_path))

    def _kmeans_centers(self, buf: DataFrame) -> DataFrame:
        """CLU2: k-means (k = q, 10 iterations) over the buffered early points."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        v = buf.withColumn("_v", array_to_vector("features"))
        km = KMeans(k=self.cfg.q, maxIter=10, seed=self.cfg.seed, featuresCol="_v").fit(v)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(km.clusterCenters())]
        return self.spark.createDataFrame(rows, "mc_id bigint, centroid array<double>")

    def _streaming_init(self, pts: DataFrame, t: int, n: int, bid: int) -> None:
        """CLU3: one streaming k-means update per batch (decay 1, batches) until
        enough points were seen; then the current batch initialises the model."""
        import numpy as np
        cfg = self.cfg
        if self._skm is None and self.tick and self._part_exists("skm", self.tick):
            kept = self.read("skm", [self.tick]).orderBy("mc_id").collect()        # q rows, after a restart
            self._skm = (np.array([r["centroid"] for r in kept]), np.array([r["rmsd"] for r in kept]))
        if self._skm is None:
            box = [(0.0, 1.0)] * cfg.dims if cfg.scaling == "batch" else bounding_box(pts, cfg.dims)
            c0 = random_centers(self.spark, cfg.q, box, cfg.seed).orderBy("mc_id").collect()
            self._skm = (np.array([r["centroid"] for r in c0]), np.zeros(cfg.q))
        centers, weights = self._skm
        cdf = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)],
                                         "mc_id bigint, centroid array<double>")
        agg = cf_aggregate(assign_nearest(pts, cdf, cfg.dims), ["mc_id"], cfg.dims).select(
            "mc_id", "n", "cf1x").collect()                     # at most q rows
        centers, weights = centers.copy(), weights.copy()
        for r in agg:
            i, m = int(r["mc_id"]), float(r["n"])
            w2 = weights[i] + m
            lam = m / max(w2, 1e-16)
            centers[i] = (1.0 - lam) * centers[i] + (lam / m) * np.asarray(r["cf1x"])
            weights[i] = w2
        self._skm = (centers, weights)
        # the state of the init, its weight in the place of a radius
        kept = self.spark.createDataFrame([(i, c.tolist(), float(w)) for i, (c, w) in enumerate(zip(centers, weights))],
                                          "mc_id bigint, centroid array<double>, rmsd double")
        self._write(self._as_step(kept, "skm"), t)
        if t > 1:
            self._drop_partition("skm", t - 2)
        if self.total + n >= cfg.min_init_points:
            cdf = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)],
                                             "mc_id bigint, centroid array<double>")
            self._init_with(cdf, pts, t, n, bid)

    def _init_with(self, centers: DataFrame, pts: DataFrame, t: int, n: int, bid: int) -> None:
        """All points are in-liers of the init tick; empty start clusters are
        dropped after the refresh (they still lend their centroid to it)."""
        cfg = self.cfg
        rows = centers.orderBy("mc_id").collect()                 # q start centers
        passed = self._pass(pts, [(r["mc_id"], r["centroid"], 0.0, 0) for r in rows], t, all_in=True)
        start = centers.select("mc_id", F.array(F.col("mc_id")).alias("ids"), F.lit(0).cast("bigint").alias("n"),
                               F.array(*[F.lit(0.0)] * cfg.dims).alias("cf1x"),
                               F.array(*[F.lit(0.0)] * cfg.dims).alias("cf2x"),
                               F.lit(0).cast("bigint").alias("cf1t"), F.lit(0).cast("bigint").alias("cf2t"),
                               F.lit(t).cast("bigint").alias("last_tick"), "centroid",
                               F.lit(0.0).alias("rmsd"))
        self.initialized = True
        self._run_group([self._as_step(start, "model"), *passed], t, n, bid, all_in=True)
        self.next_id = max(self.next_id, cfg.q)


# --------------------------------------------------------------------- replay

def bucket_by_tick(points: DataFrame, path: str) -> DataFrame:
    """Write (point_id, tick, features) once, partitioned by tick, so each step
    reads only its own tick (partition pruning instead of a scan per tick)."""
    points.select("point_id", "tick", "features").write.mode("overwrite").partitionBy("tick").parquet(path)
    return points.sparkSession.read.parquet(path)


def replay(spark: SparkSession, points: DataFrame, cfg: ModelConfig, path: str,
           unbounded: bool = False, max_ticks: int | None = None, bucket: bool = True) -> OnlineModel:
    """STR1 batch replay: feed the ticks of a static table in order.

    bucket=True lays (point_id, tick, features) out by tick once; pass
    bucket=False when `points` is already a table partitioned by tick, so each
    step prunes to its partition without a copy.
    """
    model = OnlineModel(spark, cfg, f"{path}/model", unbounded=unbounded)
    fine = usable("features", cfg.dims)
    points.where(~fine).write.mode("overwrite").parquet(f"{path}/quarantine")
    points = points.where(fine)
    bucketed = bucket_by_tick(points, f"{path}/points") if bucket else points
    sums = tick_sums(bucketed, cfg.dims)          # every tick's statistics in one job
    ticks = sorted(sums)
    if max_ticks is not None:
        ticks = ticks[:max_ticks]
    for i, t in enumerate(ticks):
        model.step(bucketed.where(F.col("tick") == t).drop("tick"), batch_id=i, sums=sums[t])
    model.flush()
    return model


# ------------------------------------------------------------------ streaming

def file_source(spark: SparkSession, source_dir: str, schema: T.StructType | None = None,
                files_per_trigger: int = 1) -> DataFrame:
    """SRC2: a folder of files as a stream: Parquet of the schema, or text lines without one."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(source_dir) if schema is None else reader.schema(schema).parquet(source_dir)


def run_stream(spark: SparkSession, stream: DataFrame, cfg: ModelConfig, path: str,
               trigger_seconds: float | None = None) -> OnlineModel:
    """STR1: any streaming DataFrame (`file_source`, `kafka_source`), one model step
    per micro-batch in foreachBatch (same thread as the batch, so the
    snapshot save cannot race the next batch). The query's checkpoint sits
    beside the model state; a restart resumes both.

    A stream of (point_id, features) is taken as it is. One with `value`: one message per
    row, "x1,x2,..." as the reference's producer sends them; lines are parsed
    (SRC3), point ids follow the batch's file and line order. Rejected lines
    (with their reason) or rows go to `<path>/quarantine`, a folder a batch.
    """
    from ..sources.points import parse_points
    model = OnlineModel(spark, cfg, f"{path}/model")
    text = "features" not in stream.columns

    def each(df: DataFrame, batch_id: int) -> None:
        if batch_id <= model.batch_id:
            return                                        # committed before a restart
        if text:
            good, bad = parse_points(df, cfg.dims)
            df = good.withColumn("point_id", F.monotonically_increasing_id())
        else:
            bad = df.where(~usable("features", cfg.dims))
        # one folder a batch: a retry replaces it
        bad.write.mode("overwrite").parquet(f"{path}/quarantine/batch_id={batch_id}")
        model.step(df, batch_id=batch_id)
        model.flush()      # the engine commits the batch when this returns: the tick must be on disk

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/stream-checkpoint")
    writer = writer.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else writer.trigger(availableNow=True)
    q = writer.start()
    q.awaitTermination()
    model.flush()
    return model


def kafka_source(spark: SparkSession, servers: str, topic: str, rate_per_partition: int = 1000,
                 partitions: int = 1, trigger_seconds: float = 1.0) -> DataFrame:
    """SRC1: the Kafka text source (needs the Kafka connector on the classpath).

    String values, earliest offsets ignored in favour of `latest`, offsets
    tracked by the query checkpoint instead of auto-commit, and a cap of
    rate x partitions x trigger seconds records per micro-batch."""
    return (spark.readStream.format("kafka")
            .options(**kafka_options(servers, topic, rate_per_partition, partitions, trigger_seconds))
            .load().select(F.col("value").cast("string").alias("value")))


def kafka_options(servers: str, topic: str, rate_per_partition: int = 1000, partitions: int = 1,
                  trigger_seconds: float = 1.0) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "latest",
        "kafka.group.id": "test",
        "maxOffsetsPerTrigger": str(int(rate_per_partition * partitions * trigger_seconds)),
    }
