"""Invariants of the stateful online loop (replay of the events stream)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddy.config import ModelConfig, work_dir
from eddy.operators import pyramid as P
from eddy.plans import inputs as I
from eddy.streaming.online import OnlineModel, file_source, replay, run_stream

from data_paths import SF_SMALL

CFG = ModelConfig(q=12, dims=2, delta=4, scaling="none", init_mode="random", alpha=2, l=1, seed=3)
TICKS = 9


@pytest.fixture(scope="module")
def run(spark):
    base = work_dir(spark, "test-online")
    pts = I.ev_points(spark, SF_SMALL)
    model = replay(spark, pts, CFG, base, max_ticks=TICKS)
    return spark, pts, model, base


def test_window_mass_equals_points_in_window(run):
    spark, pts, model, _ = run
    t = model.tick
    in_window = pts.where((F.col("tick") > t - CFG.delta) & (F.col("tick") <= t)).count()
    nxt = model.read("next", [t]).agg(F.sum("n")).first()[0]
    assert nxt == pts.where((F.col("tick") > t + 1 - CFG.delta) & (F.col("tick") <= t)).count()
    assert model.model().agg(F.sum("n")).first()[0] == in_window


def test_capacity_and_lineage(run):
    _, _, model, _ = run
    rows = model.model().collect()
    assert 0 < len(rows) <= CFG.q
    ids = [i for r in rows for i in r["ids"]]
    assert len(ids) == len(set(ids))
    assert all(r["rmsd"] >= 0 for r in rows)
    assert all(r["mc_id"] in r["ids"] for r in rows)


def test_deltas_cover_every_point(run):
    _, pts, model, _ = run
    total = model.deltas().agg(F.sum("n")).first()[0]
    assert total == pts.where(F.col("tick") <= model.tick).count() == model.total


def test_snapshots_follow_pyramidal_schedule(run):
    spark, _, model, _ = run
    ticks = spark.range(1, model.tick + 1).withColumnRenamed("id", "tick")
    want = {r[0] for r in P.retained(ticks, model.tick, CFG.alpha, CFG.l).collect()}
    got = {r[0] for r in model.read("model").select("tick").distinct().collect()}
    assert got == want


def test_restart_skips_committed_batches(run):
    spark, pts, model, base = run
    again = OnlineModel(spark, CFG, f"{base}/model")
    assert again.tick == model.tick and again.batch_id == model.batch_id
    assert again.step(pts.where(F.col("tick") == 1).drop("tick"), batch_id=0) is None
    assert again.tick == model.tick


def test_stream_equals_replay(spark):
    base = work_dir(spark, "test-stream")
    pts = I.ev_points(spark, SF_SMALL).where(F.col("tick") <= 4)
    src = f"{base}/source"
    for t in range(1, 5):
        pts.where(F.col("tick") == t).drop("tick").coalesce(1).write.mode("append").parquet(src)
    streamed = run_stream(spark, file_source(spark, src, spark.read.parquet(src).schema), CFG, f"{base}/s")
    replayed = replay(spark, pts, CFG, f"{base}/r")
    a = sorted((r["mc_id"], r["n"], tuple(r["cf1x"])) for r in streamed.model().collect())
    b = sorted((r["mc_id"], r["n"], tuple(r["cf1x"])) for r in replayed.model().collect())
    assert a == b and streamed.tick == replayed.tick == 4


def test_online_horizon_is_exact(run):
    _, pts, model, _ = run
    h = 3
    hz = model.horizon(h)
    want = pts.where((F.col("tick") > model.tick - h) & (F.col("tick") <= model.tick)).count()
    assert hz.agg(F.sum("n")).first()[0] == want
    roots = {r["mc_id"] for r in model.model().collect()}
    assert {r["mc_id"] for r in hz.collect()} <= roots


def test_fixed_q_variant_keeps_capacity_and_mass(spark):
    cfg = CFG.replace(variant="fixed", remove_expired=False, delta=2, q=6)
    pts = I.ev_points(spark, SF_SMALL)
    m = replay(spark, pts, cfg, work_dir(spark, "test-fixed"), max_ticks=6)
    rows = m.model().collect()
    assert len(rows) <= cfg.q
    # stale slots are reused, so the model may hold fewer points than were seen
    assert 0 < sum(r["n"] for r in rows) <= pts.where(F.col("tick") <= 6).count()


def test_text_stream_parses_and_quarantines(spark):
    from eddy.sources.points import points_to_text
    base = work_dir(spark, "test-text-stream")
    pts = I.ev_points(spark, SF_SMALL).where(F.col("tick") <= 3)
    src = f"{base}/source"
    for t in range(1, 4):
        lines = points_to_text(pts.where(F.col("tick") == t)).select("value")
        if t == 2:
            lines = lines.unionByName(spark.createDataFrame([("1,x",), ("7",)], "value string"))
        lines.coalesce(1).write.mode("append").text(src)
    m = run_stream(spark, file_source(spark, src), CFG, f"{base}/s")
    assert m.tick == 3 and m.total == pts.count()
    assert spark.read.parquet(f"{base}/s/quarantine").count() == 2


def _state(m):
    return sorted((r["mc_id"], r["n"], tuple(np.round(r["cf1x"], 9)), tuple(np.round(r["cf2x"], 9)), tuple(sorted(r["ids"])))
                  for r in m.model().collect())


@pytest.mark.parametrize("unbounded", [False, True])
def test_model_does_not_depend_on_the_file_layout(spark, unbounded):
    cfg = CFG.replace(remove_expired=not unbounded)
    pts = I.ev_points(spark, SF_SMALL).where(F.col("tick") <= 4)
    got = []
    for files in (1, 6, 64):
        base = work_dir(spark, f"test-layout-{files}")
        pts.repartition(files).write.partitionBy("tick").parquet(f"{base}/points")
        got.append(_state(replay(spark, spark.read.parquet(f"{base}/points"), cfg, base, unbounded=unbounded, bucket=False)))
    assert got[0] and got[0] == got[1] == got[2]


def test_unusable_points_change_nothing(spark):
    pts = I.ev_points(spark, SF_SMALL).where(F.col("tick") <= 3).select("point_id", "tick", "features")
    bad = spark.createDataFrame([(-1, 2, [float("nan"), 1.0]), (-2, 2, [1.0]), (-3, 3, None), (-4, 3, [float("inf"), 0.0])],
                                "point_id bigint, tick bigint, features array<double>")
    cfg = CFG.replace(scaling="batch")
    a = replay(spark, pts, cfg, work_dir(spark, "test-clean"))
    base = work_dir(spark, "test-dirty")
    b = replay(spark, pts.unionByName(bad), cfg, base)
    assert _state(a) == _state(b) and a.total == b.total
    assert spark.read.parquet(f"{base}/quarantine").count() == 4


def test_outlier_cells_are_bounded_and_whole(spark):
    from eddy.streaming.outliers import coarsen
    rows = [(m, [x, y], 1, m * 1000 + x * 20 + y, [float(x), float(y)], [1.0, 1.0]) for m in range(3) for x in range(-9, 10) for y in range(8)]
    cells = spark.createDataFrame(rows, "mc_id bigint, cell array<bigint>, n bigint, first_pid bigint, cf1x array<double>, cf2x array<double>")
    for q in (1000, 100, 12, 3):
        out = coarsen(cells, 2, q).collect()
        assert len(out) <= q and sum(r["n"] for r in out) == len(rows)
        assert sum(r["cf1x"][0] for r in out) == sum(r[4][0] for r in rows)


def test_online_report_covers_kept_snapshots(run):
    _, _, model, _ = run
    kept = model.snapshot_ticks()
    rep = model.report().collect()
    assert sorted({r["tick"] for r in rep}) == kept
    last = [r for r in rep if r["tick"] == model.tick]
    assert last and all(r["snapshot_n"] == sum(x["n"] for x in last) for r in last)
    assert all(r["line"].startswith("ids=[") for r in rep)


def test_restart_during_streaming_init(spark):
    cfg = CFG.replace(init_mode="streaming", min_init_points=10 ** 6)
    pts = I.ev_points(spark, SF_SMALL)
    base, other = work_dir(spark, "test-skm"), work_dir(spark, "test-skm-restart")
    whole, first = OnlineModel(spark, cfg, base), OnlineModel(spark, cfg, other)
    for t in (1, 2, 3):
        whole.step(pts.where(F.col("tick") == t).drop("tick"), batch_id=t)
    for t in (1, 2):
        first.step(pts.where(F.col("tick") == t).drop("tick"), batch_id=t)
    again = OnlineModel(spark, cfg, other)
    again.step(pts.where(F.col("tick") == 3).drop("tick"), batch_id=3)
    assert np.allclose(whole._skm[0], again._skm[0]) and np.allclose(whole._skm[1], again._skm[1])


def test_outliers_are_reported(run):
    _, _, model, _ = run
    assert len(model.reports) == TICKS and any(r.outliers > 0 for r in model.reports)


def test_reading_nothing_gives_an_empty_frame(spark):
    from eddy.sources.snapshots import read_snapshots
    assert read_snapshots(spark, work_dir(spark, "test-none"), "window", [3]).count() == 0
