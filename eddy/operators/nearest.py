"""Micro-cluster x micro-cluster searches, one model group at a time.

JOI3 nearest other, JOI4 overlap pairs, JOI5 closest pair, AGG6 minimum
non-zero distance and the PRJ5 refresh. A model group (one tick, one run,
one label) holds at most q + P*L rows, so the group is bounded by the model
capacity, not by the data: `groupBy(keys).applyInPandas` runs every group in
parallel and never materialises the q^2 pairs as rows.

Positions are the rank of mc_id inside the group. Distances accumulate
dimension by dimension, left to right, as the SQL oracle writes them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import MAX_MODEL_ROWS


def _matrix(series: pd.Series, dims: int) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dims))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]).reshape(len(series), dims)


BLOCK = 512   # rows per block: pair kernels hold BLOCK x m distances at a time


def block_sq_dist(c: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Squared distances of rows lo..hi-1 to every row, dimension by dimension."""
    acc = None
    for d in range(c.shape[1]):
        diff = c[lo:hi, None, d] - c[None, :, d]
        sq = diff * diff
        acc = sq if acc is None else acc + sq
    if acc is None:
        acc = np.zeros((hi - lo, c.shape[0]))
    return acc


def pair_sq_dist(c: np.ndarray) -> np.ndarray:
    """Full matrix (small models and tests only; kernels below use blocks)."""
    return block_sq_dist(c, 0, c.shape[0])


def _blocks(m: int):
    for lo in range(0, m, BLOCK):
        yield lo, min(m, lo + BLOCK)


def _check(pdf: pd.DataFrame):
    if len(pdf) > MAX_MODEL_ROWS:
        raise ValueError(f"model group of {len(pdf)} rows exceeds {MAX_MODEL_ROWS}")


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    _check(pdf)
    return pdf.sort_values("mc_id", kind="stable").reset_index(drop=True)


def _schema_with(df: DataFrame, keep: list[str], extra: list[T.StructField]) -> T.StructType:
    fields = [df.schema[c] for c in keep]
    return T.StructType(fields + extra)


# ------------------------------------------------------------------ kernels

def nearest_other_kernel(c: np.ndarray, tie: str = "last") -> tuple[np.ndarray, np.ndarray]:
    """Position and squared distance of the nearest other row.

    tie="last": among equal distances the highest position wins (offline scan
    from last to first with a strict `<`); tie="first": the lowest wins.
    Position -1 when the group has a single row.
    """
    m = c.shape[0]
    pos = np.full(m, -1, dtype=np.int64)
    best = np.full(m, np.inf)
    if m <= 1:
        return pos, best
    for lo, hi in _blocks(m):
        d2 = block_sq_dist(c, lo, hi)
        d2[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
        b = d2.min(axis=1)
        hit = d2 == b[:, None]
        pos[lo:hi] = (m - 1 - np.argmax(hit[:, ::-1], axis=1)) if tie == "last" else np.argmax(hit, axis=1)
        best[lo:hi] = b
    return pos, best


def nonzero_min_kernel(c: np.ndarray) -> np.ndarray:
    """sqrt of the smallest non-zero squared distance to any row, +inf if none."""
    out = np.zeros(c.shape[0])
    for lo, hi in _blocks(c.shape[0]):
        d2 = block_sq_dist(c, lo, hi)
        out[lo:hi] = np.sqrt(np.where(d2 != 0.0, d2, np.inf).min(axis=1))
    return out


def rmsd_kernel(cf1x: np.ndarray, cf2x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """sqrt(max(0, sum(cf2x)/n - sum(cf1x^2)/n^2)), sums left to right."""
    s2 = cf2x[:, 0].copy()
    s1 = cf1x[:, 0] * cf1x[:, 0]
    for d in range(1, cf1x.shape[1]):
        s2 = s2 + cf2x[:, d]
        s1 = s1 + cf1x[:, d] * cf1x[:, d]
    nd = n.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        rad = s2 / nd - s1 / (nd * nd)
    return np.sqrt(np.maximum(rad, 0.0))


def centroid_kernel(cf1x: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return cf1x / n.astype(np.float64)[:, None]


# ------------------------------------------------------------- DataFrame ops

def refresh_info(mcs: DataFrame, group: list[str], dims: int, prev_rmsd: str | None = None) -> DataFrame:
    """Centroid and RMSD of every micro-cluster of each model group (PRJ4/PRJ5/AGG6).

    n > 1: RMSD formula. n = 1: distance to the nearest centroid of the group at
    non-zero distance (+inf if none). n = 0: previous RMSD (`prev_rmsd`) or 0,
    and the previous centroid if the frame has one.
    """
    has_centroid = "centroid" in mcs.columns
    base_cols = [c for c in mcs.columns if c not in ("centroid", "rmsd")]
    if prev_rmsd and prev_rmsd not in base_cols:
        base_cols.append(prev_rmsd)
    schema = _schema_with(mcs, base_cols, [
        T.StructField("centroid", T.ArrayType(T.DoubleType())),
        T.StructField("rmsd", T.DoubleType()),
    ])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        n = pdf["n"].to_numpy(dtype=np.int64)
        cf1x = _matrix(pdf["cf1x"], dims)
        cf2x = _matrix(pdf["cf2x"], dims)
        cen = centroid_kernel(cf1x, n)
        if has_centroid:
            old = pdf["centroid"]
            for i in np.where(n <= 0)[0]:
                if old.iloc[i] is not None:
                    cen[i] = np.asarray(old.iloc[i], dtype=np.float64)
        rmsd = rmsd_kernel(cf1x, cf2x, n) if len(pdf) else np.zeros(0)
        ones = n == 1
        if ones.any():
            # the reference's refresh compares against every model centroid
            usable = ~np.isnan(cen).any(axis=1)
            near = np.full(len(pdf), np.inf)
            near[usable] = nonzero_min_kernel(cen[usable])
            rmsd = np.where(ones, near, rmsd)
        zero = n <= 0
        if zero.any():
            prev = pdf[prev_rmsd].fillna(0.0).to_numpy(dtype=np.float64) if prev_rmsd else np.zeros(len(pdf))
            rmsd = np.where(zero, prev, rmsd)
        out = pdf[base_cols].copy()
        out["centroid"] = [None if np.isnan(r).any() else r.tolist() for r in cen]
        out["rmsd"] = rmsd
        return out

    return mcs.groupBy(*group).applyInPandas(fn, schema)


def nearest_other(mcs: DataFrame, group: list[str], dims: int, tie: str = "last",
                  centroid_col: str = "centroid") -> DataFrame:
    """JOI3: (group, mc_id, near_id, near_dist) with near_id NULL when alone."""
    keep = group + ["mc_id"]
    schema = _schema_with(mcs, keep, [
        T.StructField("near_id", T.LongType()),
        T.StructField("near_dist", T.DoubleType()),
    ])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        c = _matrix(pdf[centroid_col], dims)
        pos, d2 = nearest_other_kernel(c, tie)
        ids = pdf["mc_id"].to_numpy(dtype=np.int64)
        out = pdf[keep].copy()
        out["near_id"] = pd.array([ids[p] if p >= 0 else None for p in pos], dtype="Int64")
        out["near_dist"] = np.where(pos >= 0, np.sqrt(d2), np.nan)
        return out

    return mcs.select(*keep, centroid_col).groupBy(*group).applyInPandas(fn, schema)


def nonzero_min_dist(mcs: DataFrame, group: list[str], dims: int) -> DataFrame:
    """AGG6: (group, mc_id, min_nonzero_dist); +inf when no other centroid differs."""
    keep = group + ["mc_id"]
    schema = _schema_with(mcs, keep, [T.StructField("min_nonzero_dist", T.DoubleType())])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        out = pdf[keep].copy()
        out["min_nonzero_dist"] = nonzero_min_kernel(_matrix(pdf["centroid"], dims))
        return out

    return mcs.select(*keep, "centroid").groupBy(*group).applyInPandas(fn, schema)


def overlap_pairs(mcs: DataFrame, group: list[str], dims: int) -> DataFrame:
    """JOI4: every (mc_id i, parent_id j) with pos(j) < pos(i) and dist(c_i, c_j) <= rmsd_j."""
    keep = group + ["mc_id"]
    schema = _schema_with(mcs, keep, [
        T.StructField("parent_id", T.LongType()),
        T.StructField("dist", T.DoubleType()),
    ])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        c = _matrix(pdf["centroid"], dims)
        r = pdf["rmsd"].to_numpy(dtype=np.float64)
        m = len(pdf)
        ii_l, jj_l, dd_l = [], [], []
        for lo, hi in _blocks(m):
            d = np.sqrt(block_sq_dist(c, lo, hi))
            earlier = np.arange(m)[None, :] < np.arange(lo, hi)[:, None]     # j < i
            bi, bj = np.nonzero(earlier & (d <= r[None, :]))
            ii_l.append(bi + lo)
            jj_l.append(bj)
            dd_l.append(d[bi, bj])
        ii = np.concatenate(ii_l) if ii_l else np.zeros(0, dtype=np.int64)
        jj = np.concatenate(jj_l) if jj_l else np.zeros(0, dtype=np.int64)
        dist = np.concatenate(dd_l) if dd_l else np.zeros(0)
        ids = pdf["mc_id"].to_numpy(dtype=np.int64)
        out = pdf[keep].iloc[ii].reset_index(drop=True)
        out["parent_id"] = ids[jj]
        out["dist"] = dist
        return out

    return mcs.select(*keep, "centroid", "rmsd").groupBy(*group).applyInPandas(fn, schema)


def closest_pair(mcs: DataFrame, group: list[str], dims: int) -> DataFrame:
    """JOI5: per group the pair (a, b), pos(a) < pos(b), of least distance; ties go
    to the lexicographically first pair of positions."""
    schema = _schema_with(mcs, group, [
        T.StructField("a_id", T.LongType()),
        T.StructField("b_id", T.LongType()),
        T.StructField("dist", T.DoubleType()),
    ])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        m = len(pdf)
        if m < 2:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        c = _matrix(pdf["centroid"], dims)
        best, a, b = np.inf, 0, 1
        for lo, hi in _blocks(m):
            d2 = block_sq_dist(c, lo, hi)
            later = np.arange(m)[None, :] > np.arange(lo, hi)[:, None]      # b > a
            d2 = np.where(later, d2, np.inf)
            flat = int(np.argmin(d2))      # row-major: first (a, b) of the block wins ties
            bv = d2.flat[flat]
            if bv < best:                  # strict: an earlier block keeps its tie
                best, a, b = bv, lo + flat // m, flat % m
        ids = pdf["mc_id"].to_numpy(dtype=np.int64)
        row = {g: pdf[g].iloc[0] for g in group}
        row.update(a_id=int(ids[a]), b_id=int(ids[b]), dist=float(np.sqrt(best)))
        return pd.DataFrame([row])

    return mcs.select(*group, "mc_id", "centroid").groupBy(*group).applyInPandas(fn, schema)
