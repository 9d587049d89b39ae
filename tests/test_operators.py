"""Hazards and invariants on rows written out here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import vectors as V
from cairn.operators import metrics as M
from cairn.operators import neighbours as N
from cairn.operators import points as P
from cairn.operators import solvers as S
from cairn.operators import temporal as T
from cairn.sources import scans


def cloud(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, x, y, z in rows], "pt_id long, x double, y double, z double")


def random_pose(seed):
    rng = np.random.default_rng(seed)
    return S.se3_exp(np.r_[rng.normal(0, 2, 3), rng.normal(0, 0.5, 3)])


def test_voxel_keys_truncate_or_floor(spark):
    p = cloud(spark, [(1, -0.7, 0, 0), (2, 0.7, 0, 0), (3, 1.2, 0, 0)])
    assert [r.vx for r in P.voxel_key(p, 1.0).orderBy("pt_id").collect()] == [0, 0, 1]
    assert [r.vx for r in P.voxel_key(p, 1.0, floor=True).orderBy("pt_id").collect()] == [-1, 0, 1]


def test_first_point_wins_in_any_order(spark):
    p = cloud(spark, [(3, 0.1, 0, 0), (1, 0.2, 0, 0), (2, 0.3, 0, 0)])
    assert [r.pt_id for r in P.voxel_first(p, 1.0).collect()] == [1]


def test_eviction_asks_the_first_point(spark):
    p = cloud(spark, [(1, 9.0, 0, 0), (2, 11.0, 0, 0), (3, 25.0, 0, 0)])
    assert sorted(r.pt_id for r in P.voxel_evict(p, 10.0, 10.0, (0, 0, 0)).collect()) == [1]
    assert sorted(r.pt_id for r in P.voxel_evict(p, 20.0, 10.0, (0, 0, 0)).collect()) == [1, 2]


def test_cells_bound_the_search(spark):
    one = cloud(spark, [(1, 10.5, 0, 0)])
    assert N.nearest_in_cells(one, cloud(spark, [(7, 13.0, 0, 0)]), 1.0, 6.0).count() == 0
    assert N.nearest_in_cells(one, cloud(spark, [(7, 11.9, 0, 0)]), 1.0, 6.0).collect()[0].tgt_id == 7


def test_descriptor_predicates(spark):
    d = spark.createDataFrame([([1.0, -1.0],), ([-1.0, -1.0],), ([0.0, 0.0],), ([1.0, 0.0],)], "v array<double>")
    out = d.select(V.has_nonzero_sum(F.col("v")).alias("a"), V.has_positive_sum(F.col("v")).alias("b"), V.has_no_zero(F.col("v")).alias("c")).collect()
    assert [tuple(r) for r in out] == [(False, False, True), (True, False, True), (False, False, False), (True, True, False)]


def test_median_and_deviation(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 10, 20)], "d double")
    row = M.median_mad(d, "d").collect()[0]
    assert row["median"] == 6 and abs(row["mad"] - 6.6717) < 1e-9
    same = spark.createDataFrame([(2.0,)] * 3, "d double")
    assert M.mad_inliers(same, "d").count() == 0


def test_smallest_leaves_one_out(spark):
    d = spark.createDataFrame([(1, 0.3), (2, 0.1), (3, 0.2)], "src_id long, d double")
    assert [r.src_id for r in N.smallest(d, 5000).collect()] == [2, 3]


def test_mutual(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6])], "id long, v array<double>")
    b = spark.createDataFrame([(9, [1.0, 0.0])], "id long, v array<double>")
    assert [(r.src_id, r.tgt_id) for r in N.mutual_nearest(a, b).collect()] == [(1, 9)]


def test_ball_query_pads(spark):
    s = cloud(spark, [(1, 0, 0, 0), (2, 50, 0, 0)])
    got = {(r.src_id, r.slot): r.tgt_id for r in N.ball_query(s, cloud(spark, [(5, 0.5, 0, 0)]), 1.0, 1.0, 3).collect()}
    assert got == {(1, 0): 5, (1, 1): 5, (1, 2): 5, (2, 0): 0, (2, 1): 0, (2, 2): 0}


def test_angle_is_clamped(spark):
    row = spark.range(1).select(G.rotation_degrees(G.identity() | {"r00": F.lit(1 + 1e-12)}, G.identity()).alias("d")).collect()[0]
    assert row.d == 0


def test_running_sigma(spark):
    d = spark.createDataFrame([(1, 0, 0.05), (1, 1, 0.3), (1, 2, 0.4)], "s long, i long, e double")
    got = [r.sigma for r in M.running_sigma(d, "s", "i", "e", 0.1, 2.0).orderBy("i").collect()]
    assert got == pytest.approx([2, 0.3, 0.125**0.5])


def test_nearest_time_prefers_the_earlier(spark):
    q = spark.createDataFrame([(1, 5, 10), (1, 9, 11), (2, 1, 12)], "k long, t long, q long")
    s = spark.createDataFrame([(1, 4), (1, 6)], "k long, t long")
    assert {r.q: r.nearest for r in T.nearest(q, s, "k").collect()} == {10: 4, 11: 6, 12: None}


def test_slerp_halves_a_turn(spark):
    a = tuple(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0))
    b = tuple(F.lit(x) for x in (-(0.5**0.5), 0.0, 0.0, -(0.5**0.5)))
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(T.slerp(a, b, F.lit(0.5)), "wxyz", strict=True)]).collect()[0]
    assert (row.w, row.z) == pytest.approx((np.cos(np.pi / 8), np.sin(np.pi / 8)))


def test_align_and_deskew(spark):
    z = F.lit(0.0)
    p = G.align(F.lit(1.0), z, z, z, F.lit(1.0), z)
    x, y, _ = G.apply(p, F.lit(1.0), z, z)
    start, finish = G.identity(), G.identity() | {"tx": F.lit(2.0)}
    dx = G.deskew(start, finish, F.lit(1.0), z, z, z)[0]
    row = spark.range(1).select(x.alias("x"), y.alias("y"), dx.alias("dx")).collect()[0]
    assert (row.x, row.y, row.dx) == pytest.approx((0, 1, 1))


def test_fits_recover_a_pose():
    rng = np.random.default_rng(3)
    a, t = rng.normal(0, 5, (200, 3)), random_pose(4)
    b = S.moved(a, t)
    assert np.allclose(S.rigid(a, b), t, atol=1e-5)
    noisy = b.copy()
    noisy[::2] += rng.normal(0, 20, noisy[::2].shape)
    assert np.allclose(S.ransac(a, noisy), t, atol=1e-2)
    assert np.allclose(S.refine(a, b, t, 0.5), t, atol=1e-5)
    assert np.allclose(S.orthogonal(t[:3, :3] * 1.01), t[:3, :3], atol=1e-6)


def test_icp():
    rng = np.random.default_rng(5)
    a = rng.uniform(-10, 10, (800, 3))
    guess = random_pose(1)
    assert S.icp(a, S.CellMap(1.0), guess, 3, 1) is guess
    t = S.se3_exp(np.array([0.1, -0.05, 0.05, 0.005, 0.0, 0.01]))
    grid = S.CellMap(1.0)
    grid.add(S.moved(a, t))
    assert np.allclose(S.icp(a, grid, np.eye(4), 3, 1), t, atol=1e-3)


def test_distributed_icp(spark):
    rng = np.random.default_rng(6)
    a = rng.uniform(-5, 5, (300, 3))
    t = S.se3_exp(np.array([0.05, 0, 0.02, 0, 0, 0.01]))
    s = cloud(spark, [(i, *p) for i, p in enumerate(a.tolist())])
    m = cloud(spark, [(i, *p) for i, p in enumerate(S.moved(a, t).tolist())])
    assert np.allclose(S.icp_distributed(s, m, 1.0, 2.0, 1.0, rounds=8), t, atol=1e-2)


def test_ransac_finds_few_inliers():
    rng = np.random.default_rng(9)
    a, t = rng.uniform(-20, 20, (200, 3)), random_pose(4)
    b = S.moved(a, t)
    b[12:] = rng.uniform(-20, 20, (188, 3))
    assert np.allclose(S.ransac(a, b), t, atol=1e-2)


def test_distributed_icp_says_when_rounds_run_out(spark):
    s = cloud(spark, [(i, i % 3, i // 3, i % 2) for i in range(9)])
    with pytest.warns(UserWarning, match="not converged after 1 rounds"):
        S.icp_distributed(s, s.withColumn("x", F.col("x") + 0.2), 1.0, 2.0, 1.0, rounds=1)


def test_trajectory_error_ignores_a_rigid_move():
    path = [S.se3_exp(np.array([i, i * 0.3, 0, 0, 0, 0.1 * i])) for i in range(8)]
    turn, way = S.trajectory_error(path, [random_pose(2) @ p for p in path])
    assert turn < 1e-5 and way < 1e-4


def test_stream_is_batch(spark, tmp_path):
    from cairn.streaming.odometry import odometry_stream

    rng = np.random.default_rng(8)
    base = rng.uniform(-20, 20, (400, 3))
    rows = [(1, f, i, *map(float, p)) for f in range(3) for i, p in enumerate(base + [0.2 * f, 0, 0])]
    df = spark.createDataFrame(rows, "seq_id long, frame_id long, pt_id long, x double, y double, z double")
    for f in range(3):
        df.filter(f"frame_id = {f}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = sorted(map(tuple, _odometry(df).collect()))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = odometry_stream(stream, low=1.0).writeStream.format("memory").queryName("poses").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert np.allclose(batch, sorted(map(tuple, spark.table("poses").collect())))


def _odometry(df):
    return S.odometry(df, low=1.0)


def test_scan_formats(spark, tmp_path):
    p = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "k.bin").write_bytes(p.tobytes())
    got = scans.read_scans(spark, str(tmp_path), "kitti").orderBy("pt_id").collect()
    assert [(r.x, r.y, r.z, r.intensity) for r in got] == [tuple(map(float, r)) for r in p]
    assert scans.decode(np.ascontiguousarray(p.T).tobytes(), scans.LAYOUTS["robotcar"])["y"].tolist() == [1, 5, 9]
    raw = np.array([20200, 20000, 19800, 0], "<i2").tobytes()
    assert scans.decode(raw, scans.LAYOUTS["nclt_flipped"])[["x", "y", "z"]].iloc[0].tolist() == pytest.approx([1, 0, 1])


def test_message_fields():
    data = b"".join(struct.pack(">fHB", x, n, 7) + b"\0" for x, n in ((1.5, 2), (2.5, 3)))
    out = scans.decode_message(data, [("x", 0, 7, 1), ("ring", 4, 4, 1)], 8, big_endian=True)
    assert out.to_dict("list") == {"x": [1.5, 2.5], "ring": [2, 3]}


def test_text_files(spark, tmp_path):
    (tmp_path / "poses.txt").write_text("1 0 0 4 0 1 0 5 0 0 1 6\n1 0 0 7 0 1 0 8 0 0 1 9\n")
    poses = scans.read_poses(spark, str(tmp_path / "poses.txt"))
    assert [(r.idx, r.tx, r.ty, r.tz) for r in poses.orderBy("idx").collect()] == [(0, 4, 5, 6), (1, 7, 8, 9)]
    assert scans.pose_lines(poses).orderBy("idx").collect()[0].value.split()[3] == "4.000000e+00"
    assert scans.stamped_lines(poses.withColumn("t", F.col("idx"))).orderBy("t").collect()[1].value == "1.0000 7.0000 8.0000 9.0000 0.0000 0.0000 0.0000 1.0000"
    (tmp_path / "calib.txt").write_text("P2: 1 2.5\ndate: today\n")
    assert {r.name: r.vals for r in scans.read_calibration(spark, str(tmp_path / "calib.txt")).collect()} == {"P2": [1.0, 2.5], "date": [None]}
