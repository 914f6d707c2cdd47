"""Nearest-centroid assignment (JOI1, JOI2, PRJ6, ORD2) and the in-lier split (FLT1).

Points are the big side and never move: assignment is a narrow projection with an Arrow-batched
pandas UDF that holds the centroids as a NumPy matrix. No shuffle, no row blow-up, no cross join.
A model of more than a block of centroids is searched by blocks with bounding boxes
(`kdblocks`), so that a point looks at a few blocks only and memory does not grow with rows x q.
A model of more than `MODEL_BYTES` is broadcast in slices, one pass over the points each; the best
so far stays beside the point in a written table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import work_dir
from .kdblocks import BLOCK_ROWS, BOX_CELLS, CenterBlocks

MODEL_BYTES = 64_000_000    # of centroids in one broadcast

ASSIGN_TYPE = T.StructType([
    T.StructField("mc_id", T.LongType()),
    T.StructField("dist", T.DoubleType()),
    T.StructField("radius", T.DoubleType()),
])
BEST_TYPE = T.StructType(ASSIGN_TYPE.fields + [T.StructField("d2", T.DoubleType())])


def squared_distances(x: list[np.ndarray], c: np.ndarray) -> np.ndarray:
    """rows x centers squared distances, accumulated dimension by dimension.

    Same operation order as `(x0-c0)*(x0-c0) + (x1-c1)*(x1-c1) + ...`, so ties
    and values agree bit for bit with the SQL form.
    """
    acc = None
    for d, xd in enumerate(x):
        diff = xd[:, None] - c[None, :, d]
        sq = diff * diff
        acc = sq if acc is None else acc + sq
    return acc


def model_bytes(model: DataFrame, dims: int) -> int:
    return model.count() * (dims * 8 + 64)


def collect_model(model: DataFrame, dims: int, order_col: str = "mc_id") -> dict:
    """A model, or a slice of one, as arrays on the driver; callers check `model_bytes`."""
    cols = ["mc_id", "centroid"] + [c for c in ("rmsd", "n") if c in model.columns]
    rows = model.select(*cols).orderBy(order_col).collect()
    out = {
        "ids": np.array([r["mc_id"] for r in rows], dtype=np.int64),
        "centers": np.array([list(r["centroid"]) for r in rows], dtype=np.float64).reshape(len(rows), dims),
    }
    out["rmsd"] = np.array([r["rmsd"] if "rmsd" in cols and r["rmsd"] is not None else 0.0 for r in rows])
    out["n"] = np.array([r["n"] if "n" in cols and r["n"] is not None else 0 for r in rows], dtype=np.int64)
    return out


def _radius(rmsd: np.ndarray, n: np.ndarray, t_factor: float, plain: bool = False) -> np.ndarray:
    # in-lier boundary: 2*rmsd for singleton clusters, t_factor*rmsd otherwise
    # (plain: t_factor*rmsd for every cluster, the fixed-q variant)
    return t_factor * rmsd if plain else np.where(n == 1, 2.0 * rmsd, t_factor * rmsd)


def nearest_center(x: list[np.ndarray], centers: np.ndarray, blocks: CenterBlocks | None) -> tuple[np.ndarray, np.ndarray]:
    """Position and squared distance of each point's nearest center; the first position among equals."""
    if blocks is not None:
        return blocks.nearest(np.stack(x, axis=1))
    pos, best = np.zeros(len(x[0]), dtype=np.int64), np.full(len(x[0]), np.inf)
    rows = max(1, BOX_CELLS // max(1, len(centers)))
    for at in range(0, len(pos), rows):
        d2 = squared_distances([c[at:at + rows] for c in x], centers)
        pos[at:at + rows] = np.argmin(d2, axis=1)
        best[at:at + rows] = d2[np.arange(len(d2)), pos[at:at + rows]]
    return pos, best


def make_assign_udf(model: dict, t_factor: float = 2.0, plain: bool = False, with_d2: bool = False):
    ids, centers = model["ids"], model["centers"]
    radius = _radius(model["rmsd"], model["n"], t_factor, plain)
    held: list[CenterBlocks | None] = []

    @F.pandas_udf(BEST_TYPE if with_d2 else ASSIGN_TYPE)
    def nearest(*cols: pd.Series) -> pd.DataFrame:
        x = [c.to_numpy(dtype=np.float64) for c in cols]
        if len(ids) == 0:
            nan = np.full(len(x[0]), np.nan)
            out = {"mc_id": pd.array([None] * len(x[0]), dtype="Int64"), "dist": nan, "radius": nan}
            return pd.DataFrame({**out, "d2": nan} if with_d2 else out)
        if not held:                                  # once a worker
            held.append(CenterBlocks(centers) if len(ids) > BLOCK_ROWS else None)
        pos, best = nearest_center(x, centers, held[0])
        out = {"mc_id": ids[pos], "dist": np.sqrt(best), "radius": radius[pos]}
        return pd.DataFrame({**out, "d2": best} if with_d2 else out)

    return nearest


def assign_nearest(points: DataFrame, model: DataFrame, dims: int, features: str = "features",
                   t_factor: float = 2.0, keep_struct: bool = False, plain: bool = False,
                   model_limit: int = MODEL_BYTES) -> DataFrame:
    """Add mc_id, dist and radius of the nearest centroid to every point.

    `model` has (mc_id, centroid[, rmsd, n]); its position order is mc_id.
    """
    slices = max(1, -(-model_bytes(model, dims) // model_limit))
    x = [F.col(features)[i] for i in range(dims)]
    if slices == 1:
        assigned = points.withColumn("_a", make_assign_udf(collect_model(model, dims), t_factor, plain)(*x))
    else:
        assigned = _assign_by_slices(points, model, dims, x, t_factor, plain, slices)
    if keep_struct:
        return assigned
    return assigned.select("*", "_a.mc_id", "_a.dist", "_a.radius").drop("_a")


def _assign_by_slices(points: DataFrame, model: DataFrame, dims: int, x: list, t_factor: float, plain: bool,
                      slices: int) -> DataFrame:
    """One pass a slice of the model; (squared distance, mc_id) decides, as in one scan."""
    spark, cur = points.sparkSession, points.withColumn("_a", F.lit(None).cast(BEST_TYPE))
    for k in range(slices):
        part = model.where(F.pmod(F.xxhash64("mc_id"), F.lit(slices)) == k)
        udf = make_assign_udf(collect_model(part, dims), t_factor, plain, with_d2=True)
        met = cur.withColumn("_n", udf(*x))
        better = F.col("_a.mc_id").isNull() | (F.col("_n.d2") < F.col("_a.d2")) | (
            (F.col("_n.d2") == F.col("_a.d2")) & (F.col("_n.mc_id") < F.col("_a.mc_id")))
        nxt = met.withColumn("_a", F.when(F.col("_n.mc_id").isNotNull() & better, F.col("_n")).otherwise(F.col("_a"))).drop("_n")
        path = work_dir(spark, "assign")
        nxt.write.parquet(path)
        cur = spark.read.schema(nxt.schema).parquet(path)
    return cur.withColumn("_a", F.struct("_a.mc_id", "_a.dist", "_a.radius"))


def split_inliers(assigned: DataFrame) -> DataFrame:
    """FLT1: one pass flag; callers filter `is_in` both ways on a cached frame."""
    return assigned.withColumn("is_in", F.col("dist") <= F.col("radius"))
