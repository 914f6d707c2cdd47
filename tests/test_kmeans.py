"""Set-wise k-means against plain numpy, group by group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddy.operators import kmeans as KM


def data(groups=4, n=80, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        mids = rng.normal(size=(3 + g % 2, 2)) * 50
        for i in range(n):
            x = np.round(mids[i % len(mids)] + rng.normal(size=2) * 4)
            out.append((g, i, x.tolist(), float(rng.integers(1, 9))))
    out.append((99, 0, [5.0, 5.0], 2.0))                       # one point alone
    out += [(98, i, [1.0, 1.0], 1.0) for i in range(6)]        # equal points
    return out


@pytest.fixture(scope="module")
def points(spark):
    df = spark.createDataFrame(data(), "g bigint, id bigint, features array<double>, w double")
    return df.withColumn("sx", F.transform("features", lambda x: x * F.col("w"))).cache()


def numpy_lloyd(x, w, c, rounds, tol):
    for _ in range(rounds):
        d2 = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d2.argmin(1)
        new = np.array([(x[own == k] * w[own == k, None]).sum(0) / w[own == k].sum() if (own == k).any() else c[k] for k in range(len(c))])
        moved, c = ((new - c) ** 2).sum(1).max(), new
        n = [w[own == k].sum() for k in range(len(c))]
        if moved <= tol * tol:
            break
    return c, n


def by_group(rows, value):
    out = {}
    for r in sorted(rows, key=lambda r: (r.g, r.center_id)):
        out.setdefault(r.g, []).append(value(r))
    return out


@pytest.mark.parametrize("rounds,tol", [(1, 0.0), (20, 1e-4)])
def test_lloyd_equals_numpy_with_own_stopping(spark, points, rounds, tol, monkeypatch):
    starts = KM.heaviest(points, ["g"], 3)
    got = KM.lloyd(points, starts, ["g"], 2, rounds, tol).collect()
    monkeypatch.setattr(KM, "CENTER_BYTES", 0)                  # a table of centers too large to broadcast
    assert sorted(map(tuple, KM.lloyd(points, starts, ["g"], 2, rounds, tol).collect()), key=str) == sorted(map(tuple, got), key=str)
    centers = by_group(got, lambda r: (r.center, r.n))
    raw = {}
    for g, i, x, w in data():
        raw.setdefault(g, []).append((-w, i, x))
    for g, rows in raw.items():
        start = np.array([x for _, _, x in sorted(rows)[:3]])
        x, w = np.array([r[2] for r in rows]), np.array([-r[0] for r in rows])
        want, n = numpy_lloyd(x, w, start, rounds, tol)
        assert np.allclose([c for c, _ in centers[g]], want) and np.allclose([m for _, m in centers[g]], n)


def cost(points_rows, centers):
    return sum(w * min(((np.array(x) - np.array(c)) ** 2).sum() for c in centers[g]) for g, _, x, w in points_rows)


def test_parallel_seeds_are_near_the_best_and_repeatable(spark, points):
    a = KM.parallel_seeds(points, ["g"], 3, 2, 7).collect()
    b = KM.parallel_seeds(points.repartition(5), ["g"], 3, 2, 7).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    seeds = by_group(a, lambda r: r.center)
    assert len(seeds[99]) == 1 and len(seeds[98]) == 1 and all(1 <= len(c) <= 3 for c in seeds.values())
    fit = by_group(KM.lloyd(points, spark.createDataFrame(a), ["g"], 2).collect(), lambda r: r.center)
    heavy = by_group(KM.lloyd(points, KM.heaviest(points, ["g"], 3), ["g"], 2).collect(), lambda r: r.center)
    assert cost(data(), fit) <= 1.05 * cost(data(), heavy)


def test_bisect(spark, points):
    rows = KM.bisect(points, ["g"], 4, 2).collect()
    centers = by_group(rows, lambda r: r.center)
    assert {g: len(c) for g, c in centers.items()} == {0: 4, 1: 4, 2: 4, 3: 4, 99: 1, 98: 1}
    total = by_group(rows, lambda r: r.n)
    for g in range(4):
        assert sum(total[g]) == sum(w for k, _, _, w in data() if k == g)
    single = {g: [np.average([x for k, _, x, _ in data() if k == g], axis=0, weights=[w for k, _, _, w in data() if k == g])] for g in centers}
    assert cost(data(), centers) < 0.2 * cost(data(), single)


def test_sampled_kmeans_and_algorithm_choice(spark, points):
    mcs = points.select(F.col("g").alias("tick"), F.col("id").alias("mc_id"), F.col("w").cast("bigint").alias("n"), F.col("sx").alias("cf1x"),
                        F.transform("features", lambda x: x * x * F.col("w")).alias("cf2x"), F.col("features").alias("centroid"),
                        F.lit(1).cast("bigint").alias("cf1t"), F.lit(1).cast("bigint").alias("cf2t"), F.lit(1).cast("bigint").alias("last_tick")).cache()
    drawn = KM.sampled_points(mcs, "tick", 4000, 3)
    assert {r.tick: r.s for r in drawn.groupBy("tick").agg(F.sum("w").alias("s")).collect()} == {t: 4000.0 for t in (0, 1, 2, 3, 98, 99)}
    shares = {(r.tick, r.id): r.w / 4000 for r in drawn.collect()}
    whole = {g: sum(w for k, _, _, w in data() if k == g) for g in range(4)}
    # chi-square of the draws, about the number of micro-clusters
    for g in range(4):
        chi = sum(4000 * (shares.get((g, i), 0) - w / whole[g]) ** 2 / (w / whole[g]) for k, i, _, w in data() if k == g)
        assert chi < 140, (g, chi)
    for algorithm in KM.ALGORITHMS:
        out = KM.offline_centers(mcs, 2, algorithm, k=3, start=1, end=2)
        assert {r.tick for r in out.select("tick").collect()} == {1, 2} and out.columns == ["tick", "center_id", "n", "center"]
    with pytest.raises(ValueError):
        KM.offline_centers(mcs, 2, "other")
