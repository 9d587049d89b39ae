"""Sensor rows, noise, grids, result tables and the command line against numpy and plain Python."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import __main__ as command
from cairn.functions import geometry as G
from cairn.functions import noise
from cairn.operators import solvers as S
from cairn.sources import results, sensors


def test_linked_lists_and_rings(spark):
    rows = [("a", "b"), ("b", "c"), ("c", ""), ("x", None), ("y", "gone")]
    df = spark.createDataFrame(rows, "token string, next string")
    got = {r.token: (r.head, r.idx) for r in sensors.linked_order(df).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": ("x", 0), "y": ("y", 0)}
    assert sensors.linked_order(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="ring"):
        sensors.linked_order(spark.createDataFrame([("a", "b"), ("b", "a")], "token string, next string"))


def test_radar_rows(spark):
    whole = struct.pack("<qH", 1547131046353776, 2800) + bytes([255, 0, 51, 255])
    df = spark.createDataFrame([(1, whole), (2, whole[:10] + b"\x00"), (3, b"ab"), (4, None)], "id int, data binary")
    got = {r.id: r for r in sensors.radar_rows(df).collect()}
    assert got[1].ts == 1547131046353776 and got[1].azimuth == pytest.approx(np.pi) and got[1].valid and got[1].power == [0.0, 0.2, 1.0]
    assert got[2].power == [] and not got[2].valid
    assert got[3].ts is None and got[3].power is None and got[4].azimuth is None


def test_pose_tables_and_names(spark, tmp_path):
    path = tmp_path / "ins.csv"
    path.write_text(",".join(f"c{i}" for i in range(15)) + "\n" + "77," + ",".join(str(i / 10) for i in range(1, 15)) + "\n")
    ins, rtk, vo = (sensors.read_pose_table(spark, str(path), k).collect()[0] for k in ("ins", "rtk", "vo"))
    assert (ins.ts, ins.tx, ins.tz, rtk.tx, vo.tx) == (77, 0.5, 0.7, 0.4, 0.2)
    assert ins.r20 == pytest.approx(-np.sin(1.3)) and rtk.r20 == pytest.approx(-np.sin(1.2)) and vo.r20 == pytest.approx(-np.sin(0.6))
    names = sensors.sequence_names(spark.createDataFrame([("a/b/c",), ("a",)], "path string"), 1)
    assert [r.sequence for r in names.orderBy("path").collect()] == [None, "b"]
    with pytest.raises(ValueError, match="no format"):
        sensors.read(spark, "none", "")
    np.arange(8, dtype="<f4").tofile(tmp_path / "0.bin")
    assert sensors.read(spark, "kitti", str(tmp_path)).count() == 2


def test_noise_is_by_key(spark):
    df = spark.range(20000).select(F.col("id").alias("pt_id"), *[F.lit(0.0).alias(c) for c in "xyz"])
    a = noise.jittered(df, 2.0, 5).toPandas().sort_values("pt_id")
    b = noise.jittered(df.repartition(7), 2.0, 5).toPandas().sort_values("pt_id")
    assert (a[["x", "y", "z"]].to_numpy() == b[["x", "y", "z"]].to_numpy()).all()
    v = a[["x", "y", "z"]].to_numpy()
    assert np.allclose(v.mean(0), 0, atol=0.06) and np.allclose(np.cov(v.T), 4 * np.eye(3), atol=0.15)
    poses = df.select("pt_id", *[c.alias(n) for n, c in noise.perturbed(G.identity(), 1, F.col("pt_id")).items()]).toPandas()
    assert np.allclose(poses[["tx", "ty", "tz"]].std(), [10, 10, 1], rtol=0.05)
    r = noise.random_pose(1, 2.0, 3.0, F.col("pt_id"))
    made = df.select(*[c.alias(n) for n, c in r.items()]).toPandas()
    m = made[[f"r{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3)
    assert np.allclose(m @ m.transpose(0, 2, 1), np.eye(3)) and made["tx"].abs().max() < 3


def test_runs_errors_and_caches(spark, tmp_path):
    poses = spark.createDataFrame([(1, 2.0)], "idx long, tx double")
    for run, n in (("r1", 1), ("r2", 2), ("r1", 3)):
        results.write_run(poses.withColumn("tx", F.lit(float(n))), {"error": n}, str(tmp_path / "runs"), run)
    assert [r.tx for r in results.read_run(spark, str(tmp_path / "runs")).collect()] == [2.0]
    assert [r.value for r in results.read_run(spark, str(tmp_path / "runs"), "metrics", "r1").collect()] == [3.0]
    results.write_run(poses, {}, str(tmp_path / "numbers"), "007")
    assert results.read_run(spark, str(tmp_path / "numbers")).first().run == "007"
    for mode in ("a", "b", "a"):
        results.append_errors(poses, mode, str(tmp_path / "errors"))
    assert spark.read.parquet(str(tmp_path / "errors")).filter("mode = 'a'").count() == 2
    made = []

    def make():
        made.append(1)
        return poses

    for reset in (False, False, True):
        assert results.cached(spark, str(tmp_path / "cache"), make, reset).count() == 1
    assert len(made) == 2


def test_command_line(spark, data, tmp_path, capsys):
    command.main(["list"])
    assert "depth_cloud" in capsys.readouterr().out.split()
    command.main(["run", "sphere_voxels", "--data", data, "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 288


def test_descriptors_choose_among_near_points():
    grid = S.CellMap(1.0)
    grid.add(np.array([[0.4, 0, 0, 1, 0], [0.1, 0, 0, 0, 1], [0.2, 0, 0, 0, 0]], np.float64))
    places, found = grid.nearest(np.zeros((1, 3)), 1.0, np.array([[1.0, 0.0]]))
    assert places.tolist() == [0] and found.tolist() == [[0.4, 0, 0]]
    assert grid.nearest(np.zeros((1, 3)), 1.0)[1].tolist() == [[0.1, 0, 0]]
    assert len(grid.nearest(np.zeros((1, 3)), 0.3, np.array([[1.0, 0.0]]))[0]) == 0
    assert S.unlikeness(np.array([1.0, 0]), np.array([[-1.0, 0], [0, 0], [1, 0]])) == pytest.approx([1, 1, 0.01], abs=1e-4)
    rng = np.random.default_rng(4)
    cloud = np.column_stack([rng.uniform(-5, 5, (800, 3)), rng.normal(0, 1, (800, 8))])
    t = S.se3_exp(np.array([0.3, -0.3, 0.2, 0, 0, 0.01]))
    grid = S.CellMap(1.0)
    grid.add(np.column_stack([S.moved(cloud[:, :3], t), cloud[:, 3:]]))
    assert np.allclose(S.icp(cloud, grid, np.eye(4), 1.5, 0.3), t, atol=1e-3)
    first = [np.linalg.norm(S.icp(c, grid, np.eye(4), 1.5, 0.3, rounds=1) - t) for c in (cloud, cloud[:, :3])]
    assert first[0] < 0.5 * first[1]
