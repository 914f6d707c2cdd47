"""Keyed online models: each equals a model of its own; state, horizon and expiry."""

import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from eddy.config import ModelConfig, work_dir
from eddy.plans import inputs as I
from eddy.sources import fs
from eddy.sources.points import events_points
from eddy.streaming.keyed import KeyedModels, replay_keyed
from eddy.streaming.online import replay

CFG = ModelConfig(q=8, dims=2, delta=4, scaling="none", init_mode="random", alpha=2, l=1, seed=3)
TICKS = 6


def rows(df):
    return sorted((r.mc_id, tuple(sorted(r.ids)), r.n, tuple(r.cf1x), tuple(r.cf2x), r.cf1t, r.cf2t, r.last_tick,
                   tuple(r.centroid), r.rmsd) for r in df.collect())


@pytest.fixture(scope="module")
def points(spark):
    pts = events_points(spark, SF_SMALL).where(F.col("tick") <= TICKS)
    return pts.withColumn("model", F.col("point_id") % 2).cache()


@pytest.fixture(scope="module")
def keyed(spark, points):
    base = work_dir(spark, "test-keyed")
    return replay_keyed(spark, points, CFG, base), base


def test_each_model_equals_a_model_of_its_own(spark, points, keyed):
    models, _ = keyed
    assert models.tick == TICKS
    for key in (0, 1):
        alone = replay(spark, points.where(F.col("model") == key).drop("model"), CFG, work_dir(spark, "test-alone"))
        assert rows(models.model().where(F.col("model") == key)) == rows(alone.model())


def test_scaled_models_equal_models_of_their_own(spark, points):
    cfg = CFG.replace(scaling="batch")
    models = replay_keyed(spark, points.where("tick <= 4"), cfg, work_dir(spark, "test-keyed-z"))
    alone = replay(spark, points.where("model = 1 AND tick <= 4").drop("model"), cfg, work_dir(spark, "test-alone-z"))
    a, b = rows(models.model().where("model = 1")), rows(alone.model())
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert [x for r in a for x in r[3]] == pytest.approx([x for r in b for x in r[3]], abs=1e-9)


def test_slices_of_models_give_the_same(spark, points, keyed):
    models = KeyedModels(spark, CFG, work_dir(spark, "test-slices"), model_bytes=200)
    for t in (1, 2, 3):
        models.step(points.where(F.col("tick") == t))
    whole = replay_keyed(spark, points.where("tick <= 3"), CFG, work_dir(spark, "test-whole"))
    assert rows(models.model()) == rows(whole.model())


def test_committed_and_empty_batches_are_skipped_and_restarts_resume(spark, points, keyed):
    models, base = keyed
    again = KeyedModels(spark, CFG, base)
    assert again.tick == TICKS and not again.step(points.where("tick = 3"), 2)
    assert not again.step(points.limit(0)) and again.tick == TICKS
    odd = spark.createDataFrame([(None, 1, [1.0, 2.0]), (0, 2, [1.0]), (0, 3, [float("nan"), 1.0])],
                                "model bigint, point_id bigint, features array<double>")
    assert not again.step(odd) and again.tick == TICKS


def test_horizon_by_subtraction_equals_the_deltas(spark, keyed):
    models, _ = keyed
    kept = models.manifest.live("cumulative")
    assert len(kept) > 2
    for tc in kept:
        for h in range(1, tc + 1):
            t2 = max((x for x in kept if x <= tc - h), default=0)
            want = {}
            for r in models.read("delta", list(range(t2 + 1, tc + 1))).collect():
                a = want.setdefault(r.model, [0, 0.0, 0.0, 0])
                want[r.model] = [a[0] + r.n, a[1] + r.cf1x[0], a[2] + r.cf2x[1], a[3] + r.cf1t]
            got, seen = {}, set()
            for r in models.horizon(h, tc).collect():
                assert r.n > 0 and not seen & {(r.model, i) for i in r.ids}
                seen |= {(r.model, i) for i in r.ids}
                a = got.setdefault(r.model, [0, 0.0, 0.0, 0])
                got[r.model] = [a[0] + r.n, a[1] + r.cf1x[0], a[2] + r.cf2x[1], a[3] + r.cf1t]
            assert got == want, (tc, h)
            if tc != kept[-1]:
                break


def test_horizon_of_a_cluster_equals_its_lineage(spark, keyed):
    models, _ = keyed
    t1 = models.tick
    t2 = max(x for x in models.manifest.live("cumulative") if x <= t1 - 2)
    owner = {(r.model, i): r.mc_id for r in models.read("cumulative", [t1]).collect() for i in r.ids}
    want = {}
    for r in models.read("delta", list(range(t2 + 1, t1 + 1))).collect():
        key = (r.model, owner[r.model, r.mc_id])
        n, x = want.get(key, (0, 0.0))
        want[key] = (n + r.n, x + r.cf1x[0])
    assert {(r.model, r.mc_id): (r.n, r.cf1x[0]) for r in models.horizon(2).collect()} == want


def test_centers_of_a_horizon(spark, keyed):
    models, _ = keyed
    got = {(r.model, r.mc_id): r.center for r in models.centers(2).collect()}
    for r in models.horizon(2).collect():
        assert got[r.model, r.mc_id] == [x / r.n for x in r.cf1x]


def test_expiry_drops_and_a_crash_between_steps_leaves_whole_state(spark, points):
    base = work_dir(spark, "test-expire")
    models = replay_keyed(spark, points.where("tick <= 4"), CFG, base)
    before = rows(models.model())
    # a step that fails before its commit: its folders are there, readers do not see them
    real = models.manifest.commit
    models.manifest.commit = lambda **kw: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        models.step(points.where("tick = 5"))
    models.manifest.commit = real
    other = KeyedModels(spark, CFG, base)
    assert other.tick == 4 and rows(other.model()) == before and fs.exists(spark, f"{base}/state/kind=model/tick=5")
    gone = other.expire(2)
    assert ("model", 5) in gone and not fs.exists(spark, f"{base}/state/kind=model/tick=5")
    kinds = {k for k, _ in gone}
    assert {"delta", "next", "meta"} <= kinds
    assert other.manifest.live("delta") == [2, 3, 4] and all(t >= 3 for t in other.manifest.live("cumulative"))
    other.step(points.where("tick = 5"))
    whole = replay_keyed(spark, points.where("tick <= 5"), CFG, work_dir(spark, "test-expire-2"))
    assert rows(other.model()) == rows(whole.model())


def test_a_second_writer_is_refused(spark, points):
    base = work_dir(spark, "test-two")
    a, b = KeyedModels(spark, CFG, base), KeyedModels(spark, CFG, base)
    assert a.step(points.where("tick = 1"))
    with pytest.raises(RuntimeError):
        b.step(points.where("tick = 1"))


def test_a_model_whose_clusters_all_expired_starts_again(spark):
    far = lambda t, m, k: (m, t, k, [float(k), float(t)])
    data = [far(1, 0, k) for k in range(20)] + [far(t, 1, k) for t in range(1, 9) for k in range(20)] + [far(8, 0, k) for k in range(5)]
    pts = spark.createDataFrame(data, "model bigint, tick bigint, point_id bigint, features array<double>")
    models = replay_keyed(spark, pts, CFG.replace(delta=3), work_dir(spark, "test-again"))
    got = models.model().where("model = 0").agg(F.sum("n")).first()[0]
    assert got == 5
    assert models.read("meta", [8]).where("model = 0").first().total_n == 25
