"""Hand-sized cases for the operators (ties, singletons, constant columns,
empty inputs, malformed text, retention schedule)."""

import math

import numpy as np
from pyspark.sql import functions as F

from eddy.config import ModelConfig
from eddy.operators import pyramid as P
from eddy.operators.assign import assign_nearest, split_inliers
from eddy.operators.cf import cf_aggregate, cf_sum
from eddy.operators.graph import connected_components
from eddy.operators.merge import capacity_round, macro_merge, overlap_merge
from eddy.operators.nearest import closest_pair, nearest_other, nonzero_min_dist, refresh_info
from eddy.operators.scale import standardize
from eddy.sources.points import parse_points
from eddy.streaming.model_step import MC, prune, refresh
from eddy.streaming.online import dropped_snapshot


def pts(spark, rows, dims):
    return spark.createDataFrame([(i, t, [float(x) for x in f]) for i, (t, f) in enumerate(rows)],
                                 "point_id bigint, tick bigint, features array<double>")


def centers(spark, cs):
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(cs)],
                                 "mc_id bigint, centroid array<double>")


def test_equidistant_point_goes_to_first_centroid(spark):
    p = pts(spark, [(1, [1.0, 0.0])], 2)
    c = centers(spark, [[0.0, 0.0], [2.0, 0.0]])
    row = assign_nearest(p, c, 2).first()
    assert row["mc_id"] == 0 and row["dist"] == 1.0


def test_singleton_rmsd_is_distance_to_nearest_other(spark):
    p = pts(spark, [(1, [0.0, 0.0]), (1, [3.0, 4.0]), (1, [3.0, 4.0])], 2)
    c = centers(spark, [[0.0, 0.0], [3.0, 4.0]])
    cf = cf_aggregate(assign_nearest(p, c, 2), ["tick", "mc_id"], 2)
    info = {r["mc_id"]: r for r in refresh_info(cf, ["tick"], 2).collect()}
    assert info[0]["n"] == 1 and info[0]["rmsd"] == 5.0
    assert info[1]["n"] == 2 and info[1]["rmsd"] == 0.0


def test_singleton_with_identical_twin_skips_zero_distance(spark):
    mcs = spark.createDataFrame(
        [(0, 0, 1, [1.0, 1.0], [1.0, 1.0]), (0, 1, 1, [1.0, 1.0], [1.0, 1.0]), (0, 2, 1, [4.0, 5.0], [16.0, 25.0])],
        "g bigint, mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>")
    info = {r["mc_id"]: r for r in refresh_info(mcs, ["g"], 2).collect()}
    assert info[0]["rmsd"] == 5.0 and info[1]["rmsd"] == 5.0


def test_lone_singleton_has_infinite_rmsd(spark):
    mcs = spark.createDataFrame([(0, 0, 1, [1.0], [1.0])],
                                "g bigint, mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>")
    assert math.isinf(refresh_info(mcs, ["g"], 1).first()["rmsd"])


def test_constant_column_scales_to_zero(spark):
    p = pts(spark, [(1, [5.0, 1.0]), (1, [5.0, 3.0])], 2)
    z = standardize(p, ["tick"], 2).orderBy("point_id").collect()
    assert [r["features"][0] for r in z] == [0.0, 0.0]
    assert [round(r["features"][1], 12) for r in z] == [-0.707106781187, 0.707106781187]


def test_inlier_boundary_uses_two_rmsd_for_singletons(spark):
    model = spark.createDataFrame([(0, [0.0], 1.0, 1)], "mc_id bigint, centroid array<double>, rmsd double, n bigint")
    p = pts(spark, [(1, [2.0]), (1, [2.5])], 1)
    flags = [r["is_in"] for r in split_inliers(assign_nearest(p, model, 1, t_factor=1.0)).orderBy("point_id").collect()]
    assert flags == [True, False]


def test_parse_quarantines_bad_lines(spark):
    lines = spark.createDataFrame([("1,2",), ("1,x",), ("3",), (None,), ("NaN,1",), (" 4 , 5 ",)], "value string")
    good, bad = parse_points(lines, 2)
    assert sorted(tuple(r["features"]) for r in good.collect()) == [(1.0, 2.0), (4.0, 5.0)]
    assert bad.count() == 4


def test_nearest_other_ties_go_to_highest_position(spark):
    mcs = spark.createDataFrame([(0, 0, [0.0]), (0, 1, [1.0]), (0, 2, [2.0])],
                                "g bigint, mc_id bigint, centroid array<double>")
    near = {r["mc_id"]: r["near_id"] for r in nearest_other(mcs, ["g"], 1, tie="last").collect()}
    assert near == {0: 1, 1: 2, 2: 1}
    near_first = {r["mc_id"]: r["near_id"] for r in nearest_other(mcs, ["g"], 1, tie="first").collect()}
    assert near_first[1] == 0


def test_nonzero_min_and_closest_pair(spark):
    mcs = spark.createDataFrame([(0, 0, [0.0]), (0, 1, [0.0]), (0, 2, [3.0]), (0, 3, [4.0])],
                                "g bigint, mc_id bigint, centroid array<double>")
    nz = {r["mc_id"]: r["min_nonzero_dist"] for r in nonzero_min_dist(mcs, ["g"], 1).collect()}
    assert nz == {0: 3.0, 1: 3.0, 2: 1.0, 3: 1.0}
    cp = closest_pair(mcs, ["g"], 1).first()
    assert (cp["a_id"], cp["b_id"], cp["dist"]) == (0, 1, 0.0)


def test_components_two_groups_and_singleton(spark):
    edges = spark.createDataFrame([(0, 5, 3), (0, 3, 9), (0, 7, 8)], "g bigint, src bigint, dst bigint")
    comp = {r["mc_id"]: r["component_id"] for r in connected_components(edges, ["g"]).collect()}
    assert comp == {3: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_components_long_chain_converges(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(40)], "g bigint, src bigint, dst bigint")
    comp = connected_components(edges, ["g"])
    assert comp.select("component_id").distinct().collect()[0][0] == 0


def _cf_rows(spark, rows):
    return spark.createDataFrame(
        [(0, i, n, list(map(float, s1)), list(map(float, s2)), n, n, 1) for i, (n, s1, s2) in enumerate(rows)],
        "tick bigint, mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint, "
        "last_tick bigint")


def test_overlap_merge_chain(spark):
    # three clusters on a line, each covering its predecessor: all fold into 0
    rows = [(2, [0, 0], [2, 0]), (2, [2, 0], [4, 0]), (2, [4, 0], [8, 0])]
    out = overlap_merge(_cf_rows(spark, rows), ["tick"], 2).collect()
    assert len(out) == 1 and out[0]["n"] == 6 and sorted(out[0]["ids"]) == [0, 1, 2]


def test_capacity_round_merges_closest_pair(spark):
    rows = [(1, [0, 0], [0, 0]), (1, [10, 0], [100, 0]), (1, [11, 0], [121, 0])]
    out = {r["mc_id"]: r for r in capacity_round(_cf_rows(spark, rows), ["tick"], 2).collect()}
    assert sorted(out) == [0, 1] and out[1]["n"] == 2 and sorted(out[1]["ids"]) == [1, 2]


def test_macro_merge_keeps_isolated_clusters(spark):
    rows = [(3, [0, 0], [2, 0]), (3, [3, 0], [5, 0]), (1, [100, 0], [10000, 0])]
    out = macro_merge(_cf_rows(spark, rows), ["tick"], 2).collect()
    assert sum(r["n"] for r in out) == 7


def test_cf_sum_is_additive(spark):
    rows = [(1, [1, 2], [1, 4]), (2, [3, 4], [5, 8])]
    df = _cf_rows(spark, rows).withColumn("mc_id", F.lit(7).cast("bigint"))
    r = cf_sum(df, ["mc_id"], 2).first()
    assert r["n"] == 3 and list(r["cf1x"]) == [4.0, 6.0] and list(r["cf2x"]) == [6.0, 12.0]


def test_retention_predicate_equals_literal_schedule(spark):
    for alpha, l in [(2, 2), (2, 10), (3, 1), (2, 1)]:
        kept: set[int] = set()
        for t in range(1, 400):
            kept.add(t)
            bye = dropped_snapshot(t, alpha, l)
            if bye is not None:
                kept.discard(bye)
        ticks = spark.range(1, 400).withColumnRenamed("id", "tick")
        got = {r[0] for r in P.retained(ticks, 399, alpha, l).select("tick").collect()}
        assert got == kept, (alpha, l)


def test_asof_on_empty_snapshot_table_gives_nulls(spark):
    saved = spark.createDataFrame([], "tick bigint")
    req = spark.createDataFrame([(5,)], "tc bigint")
    a = P.asof(req, saved, "tc", "t1").first()
    assert a["t1"] is None


def test_horizon_before_first_snapshot_uses_earliest(spark):
    saved = spark.createDataFrame([(4,), (8,)], "tick bigint")
    req = spark.createDataFrame([(9,), (3,)], "tc bigint")
    got = {r["tc"]: (r["t1"], r["t2"]) for r in P.snapshot_pair(req, saved, 7).collect()}
    assert got == {9: (8, 4), 3: (None, None)}


def test_model_prune_merges_last_into_earlier():
    def mc(i, c, r, n=2):
        c = np.array(c, dtype=float)
        return MC(i, [i], n, c * n, c * c * n, n, n, 1, c, r)
    mcs = [mc(0, [0.0], 5.0), mc(1, [1.0], 0.1), mc(2, [20.0], 0.1)]
    out = prune(mcs, 3)
    assert [m.mc_id for m in out] == [0, 2] and out[0].ids == [0, 1]
    refresh(out)
    assert all(m.rmsd >= 0 for m in out)


def test_config_rejects_q_below_two():
    import pytest
    with pytest.raises(ValueError):
        ModelConfig(q=1)


def test_kafka_options_follow_the_reference_run():
    from eddy.streaming.online import kafka_options
    o = kafka_options("broker:9092", "points", rate_per_partition=1000, partitions=3, trigger_seconds=1.0)
    assert o["subscribe"] == "points" and o["startingOffsets"] == "latest"
    assert o["maxOffsetsPerTrigger"] == "3000" and o["kafka.group.id"] == "test"


def test_unbounded_model_starts_empty(spark):
    from eddy.config import work_dir
    from eddy.plans import inputs as I
    from eddy.streaming.online import replay
    cfg = ModelConfig(q=2, dims=2, delta=3, scaling="none", remove_expired=False)
    pts = I.ev_points(spark, "/root/testdata/sf0.001")
    m = replay(spark, pts, cfg, work_dir(spark, "test-unbounded"), unbounded=True, max_ticks=3)
    rows = m.model().collect()
    assert sum(r["n"] for r in rows) == pts.where(F.col("tick") <= 3).count()
    assert len(rows) > 2          # no capacity cap


def test_blocked_kernels_equal_brute_force():
    from eddy.operators import nearest as N
    rng = np.random.default_rng(7)
    c = np.round(rng.normal(size=(N.BLOCK * 2 + 37, 3)) * 4)        # ties are likely
    full = N.pair_sq_dist(c)
    np.fill_diagonal(full, np.inf)
    for tie in ("first", "last"):
        pos, best = N.nearest_other_kernel(c, tie)
        assert np.array_equal(best, full.min(axis=1))
        for i in range(len(c)):
            cand = np.nonzero(full[i] == full[i].min())[0]
            assert pos[i] == (cand[-1] if tie == "last" else cand[0])
    nz = N.pair_sq_dist(c)
    nz[nz == 0] = np.inf
    assert np.array_equal(N.nonzero_min_kernel(c), np.sqrt(nz.min(axis=1)))


def test_vector_column_expressions(spark):
    from eddy.functions import vectors as V
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 2.0, 5.0], 2)], "a array<double>, b array<double>, n bigint")
    r = df.select(V.vadd("a", "b").alias("add"), V.vsub("a", "b").alias("sub"), V.vscale("a", 2.0).alias("sc"),
                  V.sq_dist("a", "b").alias("d2"), V.vsum("a").alias("s"), V.centroid("a", "n").alias("c"),
                  V.rmsd_multi("a", "b", "n").alias("r"), *V.unpack("a", 3)).first()
    assert list(r["add"]) == [1.0, 4.0, 8.0] and list(r["sub"]) == [1.0, 0.0, -2.0]
    assert list(r["sc"]) == [2.0, 4.0, 6.0] and r["d2"] == 5.0 and r["s"] == 6.0
    assert list(r["c"]) == [0.5, 1.0, 1.5] and r["a_2"] == 3.0
    assert r["r"] == math.sqrt(max(7.0 / 2 - 14.0 / 4, 0.0))


def test_vertices_and_single_tick_window(spark):
    from eddy.operators.graph import vertices
    from eddy.operators.window import window_state_at
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "g bigint, src bigint, dst bigint")
    assert sorted(r["v"] for r in vertices(edges, ["g"]).collect()) == [1, 2, 3]
    deltas = spark.createDataFrame(
        [(t, 7, 1, [float(t)], [float(t * t)], t, t * t, t) for t in range(1, 6)],
        "tick bigint, mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint, "
        "last_tick bigint")
    w = window_state_at(deltas, tc=5, delta=3, dims=1).first()
    assert w["n"] == 3 and list(w["cf1x"]) == [12.0] and w["last_tick"] == 5


def test_centers_sink_writes_lines(spark):
    from eddy.config import work_dir
    from eddy.sources.snapshots import centers, write_centers
    snaps = spark.createDataFrame([(3, 1, 2, [4.0, 6.0]), (3, 2, 0, [0.0, 0.0])],
                                  "tick bigint, mc_id bigint, n bigint, cf1x array<double>")
    path = work_dir(spark, "test-centers")
    write_centers(centers(snaps), path, run=4)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines == ["2.0,3.0_4"]


def test_horizon_subtracts_related_clusters_sequentially(spark):
    schema = ("mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint, "
              "last_tick bigint, ids array<bigint>")
    snap1 = spark.createDataFrame([(1, 10, [10.0], [10.0], 10, 10, 9, [1, 2, 3]), (4, 2, [2.0], [2.0], 2, 2, 9, [4])],
                                  schema)
    snap2 = spark.createDataFrame([(1, 6, [6.0], [6.0], 6, 6, 3, [1]), (2, 5, [5.0], [5.0], 5, 5, 3, [2]),
                                   (3, 3, [3.0], [3.0], 3, 3, 3, [3])], schema)
    out = {r["mc_id"]: r for r in P.horizon(snap1, snap2, 9, 3, 5, 1).collect()}
    # 10 - 6 = 4; 5 does not fit; 4 - 3 = 1
    assert out[1]["n"] == 1 and list(out[1]["cf1x"]) == [1.0] and sorted(out[1]["new_ids"]) == [2]
    assert out[4]["n"] == 2 and list(out[4]["new_ids"]) == [4]
    same = {r["mc_id"]: r["n"] for r in P.horizon(snap1, snap2, 9, 6, 5, 1).collect()}
    assert same == {1: 10, 4: 2}          # t1 - h < t2: nothing is subtracted


def test_macro_merge_keeps_every_cluster(spark):
    rows = [(3, [0, 0], [2, 0]), (3, [3, 0], [5, 0]), (1, [100, 0], [10000, 0])]
    full = macro_merge(_cf_rows(spark, rows), ["tick"], 2).agg(F.sum("n")).first()[0]
    assert full == 7


def test_merge_stamps_the_merge_tick(spark):
    rows = [(2, [0, 0], [2, 0]), (2, [2, 0], [4, 0]), (1, [50, 0], [2500, 0])]
    out = {r["mc_id"]: r for r in overlap_merge(_cf_rows(spark, rows), ["tick"], 2, tick=F.lit(9)).collect()}
    assert out[0]["last_tick"] == 9 and out[2]["last_tick"] == 1


def test_capacity_merge_fits_every_group(spark):
    from eddy.operators.merge import capacity_merge
    rows = [(1, [float(i * i), 0.0], [float(i ** 4), 0.0]) for i in range(9)]
    df = _cf_rows(spark, rows).unionByName(_cf_rows(spark, rows[:3]).withColumn("tick", F.lit(1).cast("bigint")))
    out = capacity_merge(df, ["tick"], 2, q=3).collect()
    by_tick = {}
    for r in out:
        by_tick.setdefault(r["tick"], []).append(r)
    assert len(by_tick[0]) == 3 and len(by_tick[1]) == 3
    assert sum(r["n"] for r in by_tick[0]) == 9
    ids = sorted(i for r in by_tick[0] for i in r["ids"])
    assert ids == list(range(9))
    # the first merge is the closest pair (0, 1): they end up together
    assert any({0, 1} <= set(r["ids"]) for r in by_tick[0])




def test_random_centers_are_distinct_and_fill_the_box(spark):
    from eddy.operators.init import random_centers
    rows = [tuple(r["centroid"]) for r in random_centers(spark, 2000, [(0.0, 1.0), (0.0, 1.0)], 42).collect()]
    assert len(set(rows)) == 2000
    assert len({(int(x * 10), int(y * 10)) for x, y in rows}) == 100
