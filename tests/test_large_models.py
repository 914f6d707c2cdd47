"""Operators on models too large for one scan or one broadcast, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddy.operators.assign import assign_nearest, squared_distances
from eddy.operators.kdblocks import CenterBlocks


@pytest.mark.parametrize("dims,q,n,rows", [(2, 1000, 4000, 32), (3, 5, 100, 512), (5, 3000, 2000, 64), (2, 1, 10, 4), (1, 700, 900, 16)])
def test_center_blocks_equal_the_full_scan(dims, q, n, rows):
    rng = np.random.default_rng(q)
    c, x = np.round(rng.normal(size=(q, dims)) * 20), np.round(rng.normal(size=(n, dims)) * 25)     # many ties
    pos, d2 = CenterBlocks(c, rows).nearest(x)
    full = squared_distances([x[:, i] for i in range(dims)], c)
    assert (pos == full.argmin(axis=1)).all() and (d2 == full.min(axis=1)).all()


def test_center_blocks_odd_values():
    c = np.array([[np.nan, 1.0], [1.0, 1.0], [1.0, 1.0], [5.0, 5.0]] * 5)
    pos, d2 = CenterBlocks(c, 2).nearest(np.array([[1.0, 1.0], [9.0, 9.0], [np.inf, 0.0]]))
    assert pos[:2].tolist() == [1, 3] and d2[:2].tolist() == [0.0, 32.0] and d2[2] == np.inf
    pos, d2 = CenterBlocks(np.zeros((0, 2))).nearest(np.zeros((3, 2)))
    assert np.isinf(d2).all()


def test_assign_by_blocks_and_slices(spark):
    rng = np.random.default_rng(3)
    c, x = np.round(rng.normal(size=(1500, 2)) * 30), np.round(rng.normal(size=(3000, 2)) * 30)
    model = spark.createDataFrame([(i * 3, v.tolist(), 1.0, 2) for i, v in enumerate(c)], "mc_id bigint, centroid array<double>, rmsd double, n bigint")
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id bigint, features array<double>")
    d2 = squared_distances([x[:, 0], x[:, 1]], c)
    want = {i: (int(d2[i].argmin()) * 3, float(np.sqrt(d2[i].min())), 2.0) for i in range(len(x))}
    for limit in (64_000_000, 30_000):                # one broadcast of blocks; four slices
        got = assign_nearest(points, model, 2, model_limit=limit).collect()
        assert {r.point_id: (r.mc_id, r.dist, r.radius) for r in got} == want
    none = assign_nearest(points.limit(0), model, 2, model_limit=30_000)
    assert none.count() == 0 and none.columns == ["point_id", "features", "mc_id", "dist", "radius"]
    empty = assign_nearest(points.limit(3), model.limit(0), 2)
    assert [r.mc_id for r in empty.collect()] == [None] * 3
