"""Operators without a query, and inner parts of those with one, against numpy and plain Python."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.operators import metrics as M
from cairn.operators import neighbours as N
from cairn.operators import points as P
from cairn.operators import solvers as S
from cairn.operators import temporal as T


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(np.asarray(xyz))], "pt_id long, x double, y double, z double")


def test_ransac_ends_by_its_rule():
    rng = np.random.default_rng(1)
    a = rng.uniform(-20, 20, (400, 3))
    t = S.se3_exp(np.array([1, 2, 3, 0.1, 0.2, 0.3]))
    b = S.moved(a, t)
    b[::2] = rng.uniform(-20, 20, b[::2].shape)
    assert np.allclose(S.ransac(a, b), t, atol=1e-4)
    assert np.allclose(S.ransac(a[:2], b[:2]), np.eye(4)) and S.ransac(np.zeros((5, 3)), np.zeros((5, 3))).shape == (4, 4)


def test_ransac_holds_blocks_of_pairs():
    """Memory beyond the pairs does not follow their number; every pair is counted."""
    rng = np.random.default_rng(5)
    a, t = rng.uniform(-50, 50, (50_000, 3)), S.se3_exp(np.array([0.4, 0, 0, 0, 0, 0.2]))
    b = S.moved(a, t)
    b[:15_000, 0] += 50
    tracemalloc.start()
    found = S.ransac(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(found, t, atol=1e-6) and peak < 60e6
    poses = np.stack([t, np.eye(4)])
    assert S.agreement(a, b, poses[:, :3, :3], poses[:, :3, 3], 0.5).tolist() == [35_000, int((((a - b) ** 2).sum(1) < 0.25).sum())]



def test_twists_and_deskew_in_numpy():
    t = S.se3_exp(np.array([1, -2, 0.5, 0.3, -0.2, 0.6]))
    assert np.allclose(S.se3_exp(S.se3_log(t)), t)
    p = np.array([[1.0, 2.0, 3.0]] * 3)
    moved = S.deskewed(p, np.array([0.0, 0.5, 1.0]), np.eye(4), t)
    assert np.allclose(moved[1], p[0]) and np.allclose(moved[2], S.moved(p[:1], S.se3_exp(0.5 * S.se3_log(t)))[0])


def test_small_motions_leave_the_map(spark):
    rng = np.random.default_rng(2)
    base = rng.uniform(-20, 20, (500, 3))
    state = S.Odometry(low=1.0, update=0.15)
    for f in range(3):
        state.register(base + [0.2 * f, 0, 0])
    last, points = state.last.copy(), len(state.map.points())
    pose = state.register(base + [0.41, 0, 0])
    assert np.allclose(state.last, last) and len(state.map.points()) == points and pose[0, 3] < last[0, 3] + 1e-9
    rows = [(7, f, i, *map(float, p)) for f in range(4) for i, p in enumerate(base + [0.2 * f, 0, 0])]
    df = spark.createDataFrame(rows, "seq_id long, frame_id long, pt_id long, x double, y double, z double")
    assert sorted(r.frame_id for r in S.odometry(df, jump=1, n_scans=2, low=1.0).collect()) == [1, 2]


def test_local_axes_and_colours(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0, 1, (200, 3)) * [3, 2, 0.1] + [0, 0, 0.05]
    row = S.local_axes(spark.createDataFrame([(1, *map(float, x)) for x in d], "src_id long, dx double, dy double, dz double")).collect()[0]
    assert abs(row.nz + 1) < 0.01 and row.least == pytest.approx(np.linalg.eigvalsh(d.T @ d / 3)[0])
    v = rng.normal(0, 1, (60, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)] + [(99, [0.0] * 5)], "id long, v array<double>").repartition(3)
    got = {r.id: r.colour for r in S.principal_colours(df, "id", "v").collect()}
    _, vectors = np.linalg.eigh(np.cov(v.T, bias=True))
    axes = vectors[:, ::-1][:, :3]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(3)])
    p = (v - v.mean(0)) @ axes
    want = np.floor(255 * (p - p.min(0)) / (p.max(0) - p.min(0)))
    assert got[99] == [0, 0, 0] and np.abs(np.array([got[i] for i in range(60)]) - want).max() <= 1
    assert S.principal_colours(df.filter("id = 99"), "id", "v").collect()[0].colour == [0, 0, 0]


def test_class_is_extended(spark):
    line = [(i * 0.3, 0, 0) for i in range(8)]
    p = cloud(spark, [*line, (50, 0, 0), (0.3, 0.5, 0), (9, 9, 9)])
    marked = p.filter("pt_id < 9")
    left = N.extended_class(p, marked, 0.5, 1.0)
    # The ends of the line are isolated but lie near its core; the lonely mark at 50 stays.
    assert sorted(r.pt_id for r in left.collect()) == [8, 10]


def test_anchors_stand_on_the_ground(spark):
    ground = cloud(spark, [(0, 0, 1), (1, 0, 4), (30, 0, 9)])
    got = {r.pt_id: r.z for r in N.on_ground(cloud(spark, [(0, 0.5, 0), (90, 0, 2)]), ground, 2.0).collect()}
    assert got == {0: 4.0, 1: 2.0}


def test_samples_and_draws_are_seeded(spark):
    p = cloud(spark, np.random.default_rng(4).normal(0, 1, (100, 3))).withColumn("k", F.col("pt_id") % 3)
    one, two = (sorted(r.pt_id for r in P.sampled(p.repartition(n), 10, 5, "k").collect()) for n in (2, 7))
    assert one == two and len(one) == 30 and P.sampled(p, 50, 5, "k").count() == 100
    kept = S.thinned_clusters(p.withColumn("c", (F.col("pt_id") % 11) - 1), "c", 0.5, 3)
    of = {r.c: r["count"] for r in kept.groupBy("c").count().collect()}
    assert of[-1] == 10 and all(n in (9, 10) for n in of.values()) and 2 <= len(of) <= 10


def test_small_settings():
    assert P.settings(100.0, 5.0) == (100.0, 5.0, 1.0) and P.settings(10.0, 50.0, 0.5) == (10.0, 0.0, 0.5)


def test_retry_takes_the_finer_matches(spark):
    few, many = spark.range(3), spark.range(100)
    assert N.retried(few, lambda: many).count() == 100 and N.retried(many, lambda: few).count() == 100


def test_preprocess_can_be_off(spark):
    p = cloud(spark, [(1, 0, 0), (50, 0, 0)])
    assert P.preprocess(p, 2, 60).count() == 1 and P.preprocess(p, 2, 60, on=False).count() == 2


def test_segments_are_strict(spark):
    """A pose just as far along as asked for is not farther."""
    rows = [(1, i, 100.0 * i, 0.0, 0.0) for i in range(4)]
    got = M.segments(spark.createDataFrame(rows, "s long, i long, tx double, ty double, tz double"), "s", "i").collect()
    assert sorted((r.first, r.length, r.last) for r in got) == [(0, 100, 2), (0, 200, 3)]


def test_pose_components(spark):
    p = G.from_euler(F.lit(0.1), F.lit(-0.2), F.lit(0.3)) | {"tx": F.lit(1.0), "ty": F.lit(2.0), "tz": F.lit(3.0)}
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(G.components(p))]).collect()[0]
    assert list(row) == pytest.approx([1, 2, 3, 0.1, -0.2, 0.3])
    q = T.pose_of_quaternion(*[F.lit(x) for x in (np.cos(0.2), 0.0, 0.0, np.sin(0.2))])
    assert spark.range(1).select(q["r00"].alias("a"), q["r10"].alias("b")).collect()[0].b == pytest.approx(np.sin(0.4))


def test_exp_has_the_bits_of_the_closed_form(spark):
    """A turn whose translation lies between two values of six decimals: 1 less a multiple of the squared angle rounds up."""
    rows = [(1.3599999999955292, 8.3, 0.3), (-2.5, 0.7, 9.1), (1e-9, 4.0, 2.0), (0.0, 4.0, 2.0)]
    zero = F.lit(0.0)
    made = G.exp([F.col("a"), F.col("b"), zero, zero, zero, F.col("w")])
    df = spark.createDataFrame(rows, "w double, a double, b double")
    got = df.select("*", *[made[c].alias(c) for c in ("r00", "r10", "tx", "ty")], ((F.sin("w") * F.col("a") - (1 - F.cos("w")) * F.col("b")) / F.nullif("w", F.lit(0.0))).alias("x")).collect()
    assert [r.tx for r in got[:2]] == [r.x for r in got[:2]] and np.floor(got[0].tx * 1e6 + 0.5) == 5793417
    assert (got[2].tx, got[2].ty) == pytest.approx((4 - 1e-9, 2 + 2e-9), abs=1e-15) and (got[3].r00, got[3].r10, got[3].tx, got[3].ty) == (1, 0, 4, 2)


def test_exp_agrees_with_numpy(spark):
    rng = np.random.default_rng(11)
    v = np.r_[rng.normal(0, 1, (40, 6)), rng.normal(0, 1, (10, 6)) * [1, 1, 1, 1e-7, 1e-7, 1e-7]]
    made = G.exp([F.col(f"v{i}") for i in range(6)])
    got = spark.createDataFrame([tuple(map(float, r)) for r in v], ", ".join(f"v{i} double" for i in range(6))).select(*[f"v{i}" for i in range(6)], *[made[c].alias(c) for c in G.NAMES]).collect()
    for r in got:
        want = S.se3_exp(np.array(r[:6]))
        assert np.allclose(r[6:15], want[:3, :3].ravel(), atol=1e-12) and np.allclose(r[15:], want[:3, 3], atol=1e-12)
