"""The per-tick model step of the online algorithm (STR1 fold, STR5 second
level, STR6 capacity, STR10 prune, STR4 expiry, PRJ5 refresh).

Input of one model group (at most 2q + window-delta rows, bounded by the model
capacity, never by the data; the unbounded variant holds all its clusters):

  kind='model'  the model after expiry that assigned this tick's points
  kind='in'     in-lier CF per micro-cluster of this tick
  kind='new'    CF rows of the outlier cells (first_pid order)
  kind='wd'     earlier tick deltas still inside the next window

Output rows: kind='model' (state at the end of the tick), 'next' (the same
after dropping the tick that leaves the window: it assigns the next tick's
points) and 'delta' (this tick's contribution per micro-cluster id).

The rules follow the sequential reference: a new row is absorbed by the
nearest cluster created this tick when within 2*rmsd; else, at capacity, the
closest pair is merged first (ties: first pair in mc_id order); then
overlapping clusters are merged from last to first into the highest earlier
cluster whose rmsd covers them. The window model is re-aggregated from the
deltas (exact, no subtraction drift).
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from ..config import MAX_MODEL_ROWS
from ..operators.recency import stamp_np

DOUBLES = T.ArrayType(T.DoubleType())
STEP_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("model", T.LongType()),
    T.StructField("mc_id", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("n", T.LongType()),
    T.StructField("cf1x", DOUBLES),
    T.StructField("cf2x", DOUBLES),
    T.StructField("cf1t", T.LongType()),
    T.StructField("cf2t", T.LongType()),
    T.StructField("last_tick", T.LongType()),
    T.StructField("centroid", DOUBLES),
    T.StructField("rmsd", T.DoubleType()),
    T.StructField("first_pid", T.LongType()),
    T.StructField("dtick", T.LongType()),
    # commit row (kind='meta'): the tick's bookkeeping, written in the same job
    T.StructField("total_n", T.LongType()),
    T.StructField("next_id", T.LongType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("initialized", T.BooleanType()),
])
COLS = [f.name for f in STEP_SCHEMA.fields]


@dataclasses.dataclass
class MC:
    mc_id: int
    ids: list
    n: int
    s1: np.ndarray
    s2: np.ndarray
    cf1t: int
    cf2t: int
    last_tick: int
    centroid: np.ndarray
    rmsd: float
    new: bool = False


def _rmsd(s1, s2, n) -> float:
    a, b = s2[0], s1[0] * s1[0]
    for d in range(1, len(s1)):
        a, b = a + s2[d], b + s1[d] * s1[d]
    nd = float(n)
    return float(np.sqrt(max(a / nd - b / (nd * nd), 0.0)))


def _d2(a: np.ndarray, b: np.ndarray) -> float:
    acc = (a[0] - b[0]) * (a[0] - b[0])
    for d in range(1, len(a)):
        acc = acc + (a[d] - b[d]) * (a[d] - b[d])
    return float(acc)


def _nearest_nonzero(c: np.ndarray, others: list[MC]) -> float:
    best = np.inf
    for o in others:
        d = _d2(c, o.centroid)
        if d != 0.0 and d < best:
            best = d
    return float(np.sqrt(best))


def refresh(mcs: list[MC]) -> None:
    """Centroid = cf1x/n (n > 0); rmsd by formula (n > 1), nearest non-zero
    centroid distance (n = 1)."""
    for m in mcs:
        if m.n > 0:
            m.centroid = m.s1 / float(m.n)
        if m.n > 1:
            m.rmsd = _rmsd(m.s1, m.s2, m.n)
    for m in mcs:
        if m.n == 1:
            m.rmsd = _nearest_nonzero(m.centroid, mcs)


def merge_into(a: MC, b: MC, tick: int) -> None:
    """AGG8: b's features are added to a; ids concatenate; a is touched now."""
    a.s1 = a.s1 + b.s1
    a.s2 = a.s2 + b.s2
    a.n += b.n
    a.cf1t += b.cf1t
    a.cf2t += b.cf2t
    a.ids = a.ids + b.ids
    a.last_tick = tick
    a.centroid = a.s1 / float(a.n)
    a.rmsd = _rmsd(a.s1, a.s2, a.n)


def closest_pair(mcs: list[MC]) -> tuple[int, int]:
    best, pair = np.inf, (0, 1)
    cs = np.stack([m.centroid for m in mcs])
    for i in range(len(mcs)):
        diff = cs[i + 1:] - cs[i]
        if len(diff) == 0:
            continue
        d2 = diff[:, 0] * diff[:, 0]
        for d in range(1, cs.shape[1]):
            d2 = d2 + diff[:, d] * diff[:, d]
        j = int(np.argmin(d2))
        if d2[j] < best:
            best, pair = float(d2[j]), (i, i + 1 + j)
    return pair


def prune(mcs: list[MC], tick: int) -> list[MC]:
    """STR10: from last to first, merge into the highest earlier overlapping one."""
    mcs = [m for m in mcs if m.n > 0]
    i = len(mcs) - 1
    while i > 0:
        for j in range(i - 1, -1, -1):
            if np.sqrt(_d2(mcs[i].centroid, mcs[j].centroid)) <= mcs[j].rmsd:
                merge_into(mcs[j], mcs[i], tick)
                del mcs[i]
                break
        i -= 1
    return mcs


def step_group(pdf: pd.DataFrame, tick: int, next_id: int, q: int, delta: int, remove_expired: bool,
               recursive: bool, unbounded: bool = False, all_in: bool = False,
               total_n: int = 0, batch_id: int = 0, variant: str = "dynamic", m_last: int = 500,
               t_factor: float = 2.0) -> pd.DataFrame:
    if len(pdf) > MAX_MODEL_ROWS:
        raise ValueError(f"model step of {len(pdf)} rows exceeds {MAX_MODEL_ROWS}")
    model_key = int(pdf["model"].iloc[0])

    def vec(v):
        return np.asarray(v, dtype=np.float64)

    mcs: dict[int, MC] = {}
    for r in pdf[pdf["kind"] == "model"].sort_values("mc_id").itertuples(index=False):
        mcs[int(r.mc_id)] = MC(int(r.mc_id), [int(x) for x in r.ids], int(r.n), vec(r.cf1x), vec(r.cf2x),
                               int(r.cf1t), int(r.cf2t), int(r.last_tick) if r.last_tick == r.last_tick else 0,
                               vec(r.centroid), float(r.rmsd))
    deltas: list[tuple] = []
    # fold this tick's in-lier CF (JOI10 / AGG2)
    for r in pdf[pdf["kind"] == "in"].itertuples(index=False):
        m = mcs.get(int(r.mc_id))
        s1, s2 = vec(r.cf1x), vec(r.cf2x)
        if m is None:
            m = mcs[int(r.mc_id)] = MC(int(r.mc_id), [int(r.mc_id)], 0, np.zeros_like(s1), np.zeros_like(s2),
                                       0, 0, tick, s1 / r.n, 0.0)
        m.s1, m.s2, m.n = m.s1 + s1, m.s2 + s2, m.n + int(r.n)
        m.cf1t += int(r.cf1t)
        m.cf2t += int(r.cf2t)
        m.last_tick = tick
        deltas.append((int(r.mc_id), int(r.n), s1, s2, int(r.cf1t), int(r.cf2t)))
    order = sorted(mcs)
    mlist = [mcs[k] for k in order]
    if all_in:
        # initialisation: every point is an in-lier; empty start clusters
        # lend their centroids to the singleton rmsd and are dropped after
        refresh(mlist)
        mlist = [m for m in mlist if m.n > 0]
    # otherwise outliers, capacity and prune see the centroids and radii of before the tick;
    # clusters that an outlier touches are brought up to date by the merge
    new_rows = pdf[pdf["kind"] == "new"].sort_values("first_pid")
    outliers = int(new_rows["n"].sum()) if len(new_rows) else 0
    # VAR2/VAR3: slots of clusters that were empty or stale before this tick's outliers
    stale = [m.mc_id for m in mlist if m.n == 0 or stamp_np(m.n, m.cf1t, m.cf2t, m_last) < tick - delta]
    new_delta: dict[int, list] = {}
    for r in new_rows.itertuples(index=False):
        s1, s2, n = vec(r.cf1x), vec(r.cf2x), int(r.n)
        c = s1 / float(n)
        fresh = [m for m in mlist if m.new]
        # unbounded variant: the absorb radius doubles once the model is large
        factor = t_factor if variant == "fixed" else 4.0 if unbounded and len(mlist) > 50 else 2.0
        if recursive and fresh:
            d2 = [_d2(c, m.centroid) for m in fresh]
            k = int(np.argmin(d2))
            if np.sqrt(d2[k]) <= factor * fresh[k].rmsd:
                nb = MC(-1, [], n, s1, s2, n * tick, n * tick * tick, tick, c, 0.0)
                merge_into(fresh[k], nb, tick)
                new_delta[fresh[k].mc_id][0] += n
                new_delta[fresh[k].mc_id][1] = new_delta[fresh[k].mc_id][1] + s1
                new_delta[fresh[k].mc_id][2] = new_delta[fresh[k].mc_id][2] + s2
                continue
        if variant == "fixed":
            # VAR2/VAR3: take the slot of a stale (or empty) cluster, else at capacity
            # merge the closest pair among the clusters kept from before this tick
            if stale:
                gone = stale.pop(0)
                mlist = [m for m in mlist if m.mc_id != gone]
            elif len(mlist) >= q:
                kept = [i for i, m in enumerate(mlist) if not m.new]
                if len(kept) >= 2:
                    a, b = closest_pair([mlist[i] for i in kept])
                    merge_into(mlist[kept[a]], mlist[kept[b]], tick)
                    del mlist[kept[b]]
        elif not unbounded and len(mlist) >= q:
            i, j = closest_pair(mlist)
            merge_into(mlist[i], mlist[j], tick)
            del mlist[j]
        m = MC(next_id, [next_id], n, s1, s2, n * tick, n * tick * tick, tick, c,
               _rmsd(s1, s2, n) if n > 1 else 0.0, new=True)
        if n == 1:
            m.rmsd = float(r.rmsd) if r.rmsd == r.rmsd and r.rmsd > 0 else _nearest_nonzero(c, mlist)
        mlist.append(m)
        new_delta[next_id] = [n, s1, s2]
        next_id += 1
    for k, (n, s1, s2) in new_delta.items():
        deltas.append((k, n, s1, s2, n * tick, n * tick * tick))
    if unbounded:
        # VAR4: clusters that were stale before this tick's outliers go
        mlist = [m for m in mlist if m.mc_id not in set(stale)]
    if outliers > 0 and not all_in and variant == "dynamic":
        mlist = prune(mlist, tick)
    refresh(mlist)

    out = []
    for m in mlist:
        out.append(("model", model_key, m.mc_id, m.ids, m.n, m.s1.tolist(), m.s2.tolist(), m.cf1t, m.cf2t,
                    m.last_tick, m.centroid.tolist(), m.rmsd, None, tick))
    for k, n, s1, s2, t1, t2 in deltas:
        out.append(("delta", model_key, k, [k], n, s1.tolist(), s2.tolist(), t1, t2, tick, None, None, None, tick))

    # the model that assigns the next tick: the window (tick+1-delta, tick]
    if remove_expired:
        root_of = {i: m.mc_id for m in mlist for i in m.ids}
        agg: dict[int, list] = {}
        # tick + 1 - delta leaves the window before tick + 1 is assigned
        wd = pdf[(pdf["kind"] == "wd") & (pdf["dtick"] > tick + 1 - delta)]
        rows = [(int(r.mc_id), int(r.n), vec(r.cf1x), vec(r.cf2x), int(r.cf1t), int(r.cf2t), int(r.dtick))
                for r in wd.itertuples(index=False)]
        if delta > 1:
            rows += [(k, n, s1, s2, t1, t2, tick) for k, n, s1, s2, t1, t2 in deltas]
        for k, n, s1, s2, t1, t2, dt in rows:
            root = root_of.get(k)
            if root is None:
                continue
            a = agg.setdefault(root, [0, np.zeros_like(s1), np.zeros_like(s2), 0, 0, 0])
            a[0] += n
            a[1] = a[1] + s1
            a[2] = a[2] + s2
            a[3] += t1
            a[4] += t2
            a[5] = max(a[5], dt)
        nxt = []
        for m in mlist:
            a = agg.get(m.mc_id)
            if a is None or a[0] <= 0:
                continue       # everything this cluster held has left the window
            nxt.append(MC(m.mc_id, m.ids, a[0], a[1], a[2], a[3], a[4], a[5], m.centroid, m.rmsd))
        refresh(nxt)
    else:
        nxt = mlist
    for m in nxt:
        out.append(("next", model_key, m.mc_id, m.ids, m.n, m.s1.tolist(), m.s2.tolist(), m.cf1t, m.cf2t,
                    m.last_tick, m.centroid.tolist(), m.rmsd, None, tick))
    used = [i for m in mlist for i in m.ids] + [next_id - 1]
    meta = ("meta", model_key, None, None, outliers) + (None,) * 8 + (tick, total_n, max(used) + 1, batch_id, True)
    return pd.DataFrame([r + (None, None, None, None) for r in out] + [meta], columns=COLS)
