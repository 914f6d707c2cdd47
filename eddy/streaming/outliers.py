"""Point pass of a tick (JOI1, FLT1, AGG1) with the outliers' cells (STR5, first level).

The reference walks every outlier of a batch on the driver, in arrival order.
Here an outlier belongs to a cell: its nearest micro-cluster and its offset
from that centroid, divided by the cluster's boundary radius and floored. Cells
and in-lier sums come out of one aggregate with map-side combine; the result is
a function of the points alone, whatever files or partitions hold them.

A capacity-bound model takes at most q new clusters a tick: the cells' width
doubles (coordinates halve) until at most q are left, each coarser cell being the
sum of its parts. The unbounded model keeps the finest cells. Deviation from the
arrival-order walk: neighbours in a cell join whatever came first, and a point
within the radius of another cell's first point stays in its own cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.assign import make_assign_udf

# Doublings tried in one pass; coarser than that, a cell is its whole cluster's outliers.
LEVELS = 24


def cell_of(features, centroid, radius, dims: int):
    """Cell coordinates; a cluster without extent, or no cluster, counts with width 1."""
    width = F.when(radius > 0, radius).otherwise(F.lit(1.0))
    return F.array(*[F.floor((features[d] - F.coalesce(centroid[d], F.lit(0.0))) / width).cast("bigint") for d in range(dims)])


def cell_sums(points: DataFrame, dims: int, keys: list) -> DataFrame:
    """(keys, n, cf1x, cf2x, first_pid): CF sums of points per key."""
    f = F.col("features")
    agg = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first_pid"),
        *[F.sum(f[d]).alias(f"_a{d}") for d in range(dims)], *[F.sum(f[d] * f[d]).alias(f"_b{d}") for d in range(dims)])
    return agg.select(*keys, "n", "first_pid", F.array(*[F.col(f"_a{d}") for d in range(dims)]).alias("cf1x"),
                      F.array(*[F.col(f"_b{d}") for d in range(dims)]).alias("cf2x"))


def point_pass(pts: DataFrame, centers: DataFrame, model: dict, dims: int, t_factor: float, all_in: bool = False,
               variant: str = "dynamic") -> DataFrame:
    """(mc_id, cell, n, first_pid, cf1x, cf2x): in-lier sums per micro-cluster (cell is null) and
    outlier sums per cell. `centers` (mc_id, centroid) and `model` are the same clusters; the
    fixed-q variant splits at one RMSD."""
    udf = make_assign_udf(model, 1.0 if variant == "fixed" else t_factor, plain=variant == "fixed")
    near = pts.withColumn("_a", udf(*[F.col("features")[i] for i in range(dims)])).select(
        "point_id", "features", F.coalesce("_a.mc_id", F.lit(-1)).alias("mc_id"), "_a.dist", "_a.radius")
    is_in = F.lit(True) if all_in else F.coalesce(F.col("dist") <= F.col("radius"), F.lit(False))
    placed = near.join(centers.select("mc_id", "centroid"), "mc_id", "left")
    cell = F.when(~is_in, cell_of(F.col("features"), F.col("centroid"), F.col("radius"), dims))
    return cell_sums(placed.withColumn("cell", cell), dims, ["mc_id", "cell"])


def coarsen(cells: DataFrame, dims: int, q: int) -> DataFrame:
    """Outlier cells summed to at most q: the least doubling that leaves q, else one cell a cluster
    (and then, with more than q clusters, the nearest ids' cells together)."""
    sizes = (cells.select("mc_id", "cell", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("k"))
             .select("k", "mc_id", F.transform("cell", lambda x: F.call_function("shiftright", x, F.col("k"))).alias("c"))
             .distinct().groupBy("k").agg(F.count(F.lit(1)).alias("cells")).collect())       # LEVELS + 1 rows
    fits = [r["k"] for r in sizes if r["cells"] <= q]
    if not sizes or 0 in fits:
        return cells
    if fits:
        k = min(fits)
        key = F.transform("cell", lambda x: F.call_function("shiftright", x, F.lit(k)))
    else:
        key = F.transform("cell", lambda x: F.lit(0).cast("bigint"))
    return _summed(cells.withColumn("cell", key), dims)


def _summed(cells: DataFrame, dims: int) -> DataFrame:
    agg = cells.groupBy("mc_id", "cell").agg(
        F.sum("n").alias("n"), F.min("first_pid").alias("first_pid"),
        *[F.sum(F.col(v)[d]).alias(f"_{v}{d}") for v in ("cf1x", "cf2x") for d in range(dims)])
    return agg.select("mc_id", "cell", "n", "first_pid",
                      *[F.array(*[F.col(f"_{v}{d}") for d in range(dims)]).alias(v) for v in ("cf1x", "cf2x")])


def step_rows(passed: DataFrame, dims: int, q: int | None, tick: int, key: int, schema: T.StructType) -> list[DataFrame]:
    """The model step's rows (kinds `in` and `new`) of a cached point pass; q = None keeps every cell."""
    ins = passed.where(F.col("cell").isNull()).select(
        "*", F.lit("in").alias("kind"), (F.col("n") * tick).alias("cf1t"), (F.col("n") * (tick * tick)).alias("cf2t"),
        F.lit(tick).alias("last_tick")).drop("first_pid")
    cells = passed.where(F.col("cell").isNotNull())
    news = (cells if q is None else coarsen(cells, dims, q)).withColumn("kind", F.lit("new")).drop("mc_id")
    out = []
    for df in (ins, news):
        df = df.withColumn("model", F.lit(key))
        out.append(df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                               for f in schema.fields]))
    return out
