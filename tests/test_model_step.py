"""The bounded per-model step on hand-built inputs (no Spark needed)."""

import numpy as np
import pandas as pd

from eddy.streaming.model_step import COLS, step_group


def row(kind, **kw):
    r = dict.fromkeys(COLS)
    r.update(kind=kind, model=0, **kw)
    return r


def model_row(mc_id, pts, tick=1):
    x = np.array(pts, dtype=float)
    return row("model", mc_id=mc_id, ids=[mc_id], n=len(x), cf1x=x.sum(0).tolist(), cf2x=(x * x).sum(0).tolist(),
               cf1t=len(x) * tick, cf2t=len(x) * tick * tick, last_tick=tick, centroid=x.mean(0).tolist(),
               rmsd=0.5)


def new_row(pid, p):
    p = np.array(p, dtype=float)
    return row("new", first_pid=pid, n=1, cf1x=p.tolist(), cf2x=(p * p).tolist())


def in_row(mc_id, pts, tick):
    x = np.array(pts, dtype=float)
    return row("in", mc_id=mc_id, n=len(x), cf1x=x.sum(0).tolist(), cf2x=(x * x).sum(0).tolist(),
               cf1t=len(x) * tick, cf2t=len(x) * tick * tick, last_tick=tick)


def run(rows, tick=2, q=2, delta=5, expire=True, **kw):
    out = step_group(pd.DataFrame(rows, columns=COLS), tick, next_id=100, q=q, delta=delta,
                     remove_expired=expire, recursive=True, **kw)
    return {k: out[out["kind"] == k] for k in ("model", "next", "delta", "meta")}


BASE = [model_row(0, [[0, 0], [0, 1]]), model_row(1, [[10, 10], [10, 11]])]


def test_all_inliers_fold_without_new_clusters():
    out = run(BASE + [in_row(0, [[0, 0]], 2), in_row(1, [[10, 10], [10, 10]], 2)])
    m = out["model"].set_index("mc_id")
    assert list(m.index) == [0, 1] and m.loc[0, "n"] == 3 and m.loc[1, "n"] == 4
    assert m.loc[1, "last_tick"] == 2 and m.loc[1, "cf1t"] == 2 * 1 + 2 * 2
    assert sorted(out["delta"]["mc_id"]) == [0, 1]


def test_more_outliers_than_q_keeps_capacity_and_mass():
    far = [new_row(i, [100 * (i + 1), -50 * i]) for i in range(5)]
    out = run(BASE + far, q=2)
    m = out["model"]
    assert len(m) <= 2
    assert m["n"].sum() == 4 + 5
    ids = [i for r in m["ids"] for i in r]
    assert len(ids) == len(set(ids))
    assert out["delta"]["n"].sum() == 5


def test_absorb_into_cluster_created_this_tick():
    close = [new_row(1, [50, 50]), new_row(2, [50, 50.1])]
    out = run(BASE + close, q=10)
    m = out["model"]
    created = m[m["mc_id"] >= 100]
    assert len(created) == 1 and created["n"].iloc[0] == 2


def test_window_shorter_than_a_tick_empties_the_next_model():
    out = run(BASE + [in_row(0, [[0, 0]], 2)], delta=1)
    assert len(out["next"]) == 0 and out["model"]["n"].sum() == 5


def test_commit_row_carries_next_id():
    out = run(BASE + [new_row(7, [500, 500])], q=5, total_n=9, batch_id=3)
    meta = out["meta"].iloc[0]
    assert meta["next_id"] == 101 and meta["total_n"] == 9 and meta["batch_id"] == 3


def test_fixed_q_absorbs_only_into_clusters_of_this_tick():
    """VAR3: an outlier near an old cluster founds a new one; the next, within t_factor * rmsd of that, joins it."""
    rows = BASE + [new_row(1, [0, 3]), new_row(2, [0, 4])]
    near = run(rows, q=10, variant="fixed", t_factor=3.0)["model"]
    assert near[near["mc_id"] >= 100]["n"].tolist() == [2] and near.set_index("mc_id").loc[0, "n"] == 2
    apart = run(rows, q=10, variant="fixed", t_factor=0.1)["model"]
    assert sorted(apart[apart["mc_id"] >= 100]["n"]) == [1, 1]


def test_fixed_q_takes_a_stale_slot_before_capacity():
    out = run(BASE + [new_row(1, [50, 50])], tick=20, q=10, delta=5, variant="fixed", m_last=1)["model"]
    assert sorted(out["mc_id"]) == [1, 100]


def test_unbounded_model_deletes_stale_clusters():
    out = run(BASE + [in_row(1, [[10, 10]] * 9, 20)], tick=20, q=2, delta=5, unbounded=True, expire=False, m_last=1)["model"]
    assert out["mc_id"].tolist() == [1]
