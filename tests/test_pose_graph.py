"""The pose graph against known poses, a dense solver with numeric derivatives, and its update rule."""

import numpy as np
import pandas as pd
import pytest

from cairn.operators import pose_graph as PG
from cairn.operators import solvers as S


def graph(n, noise, seed=0):
    """Poses along a bend, and rows of their factors with loops from each seventh vertex back."""
    rng = np.random.default_rng(seed)
    step = S.se3_exp(np.array([1, 0.1, 0.05, 0.02, -0.01, 0.15]))
    truth = [S.se3_exp(rng.normal(0, 0.3, 6))]
    rows = [("prior", None, 0, None, truth[0])]
    for k in range(1, n):
        truth.append(truth[-1] @ step)
        rows.append(("odom", k - 1, k, 0.1, step @ S.se3_exp(rng.normal(0, noise, 6))))
        if k % 7 == 0:
            rows.append(("loop", k - 7, k, 0.05, np.linalg.inv(truth[k - 7]) @ truth[k] @ S.se3_exp(rng.normal(0, noise / 4, 6))))
    return truth, rows


def frame(rows):
    return pd.DataFrame([{"g": 1, "k": k, "kind": a, "src": b, "dst": c, "sigma": s} | S.pose_row(z) for k, (a, b, c, s, z) in enumerate(rows)])


def matrices(out):
    t = np.tile(np.eye(4), (len(out), 1, 1))
    flat = out[S.POSE_COLUMNS].to_numpy()
    t[:, :3, :3], t[:, :3, 3] = flat[:, :9].reshape(-1, 3, 3), flat[:, 9:]
    return t


def factors_of(rows):
    return np.array([-1 if r[0] == "prior" else r[1] for r in rows]), np.array([r[2] for r in rows]), np.stack([r[4] for r in rows]), np.array([PG.PRIOR if r[0] == "prior" else 1 / r[3] ** 2 for r in rows])


def test_log_undoes_exp():
    v = np.random.default_rng(1).normal(0, 0.8, (50, 6))
    v[0] = 0
    assert np.allclose(PG.logs(np.stack([S.se3_exp(x) for x in v])), v, atol=1e-9)


def test_exact_factors_give_the_known_poses():
    truth, rows = graph(40, 0.0)
    assert np.allclose(matrices(PG.solve(frame(rows))), np.stack(truth), atol=1e-9)


def test_same_as_dense_solver():
    truth, rows = graph(16, 0.04)
    found = matrices(PG.solve(frame(rows)))
    i, j, z, weight = factors_of(rows)

    def residual(x):
        t = poses @ np.stack([S.se3_exp(v) for v in x.reshape(-1, 6)])
        start = [np.eye(4) if a < 0 else t[a] for a in i]
        return np.concatenate([np.sqrt(w) * PG.logs((np.linalg.inv(m) @ np.linalg.inv(s) @ t[b])[None])[0] for s, b, m, w in zip(start, j, z, weight, strict=True)])

    poses = np.stack(truth)
    for _ in range(8):
        zero, h = np.zeros(6 * len(poses)), 1e-6
        jac = np.stack([(residual(zero + h * e) - residual(zero - h * e)) / (2 * h) for e in np.eye(len(zero))], 1)
        x = np.linalg.lstsq(jac, -residual(zero), rcond=None)[0]
        poses = poses @ np.stack([S.se3_exp(v) for v in x.reshape(-1, 6)])
    assert np.allclose(found, poses, atol=1e-5)
    assert PG.cost(found, factors_of(rows)) < PG.cost(np.stack(truth), factors_of(rows))


def test_loops_bring_a_drifting_path_back():
    truth, rows = graph(71, 0.03, 3)
    alone = matrices(PG.solve(frame([r for r in rows if r[0] != "loop"])))
    both = matrices(PG.solve(frame(rows)))
    off = lambda t: np.linalg.norm(t[:, :3, 3] - np.stack(truth)[:, :3, 3], axis=1).mean()
    assert off(both) < 0.6 * off(alone)


def test_updates():
    assert PG.updates(["prior", "odom", "odom"]) == [True] * 3
    kinds = ["prior", "odom", "odom", "odom", "loop", "odom", "loop", "odom", "odom"]
    assert PG.updates(kinds, 3) == [False, False, True, False, True, True, False, False, True]


def test_vertices_after_the_last_update_go_on_by_measurements():
    _, rows = graph(10, 0.05)
    rows = [r for r in rows if r[0] != "loop"]
    out = PG.solve(frame(rows), 4)
    assert out["solved"].tolist() == [True] * 8 + [False] * 2
    t = matrices(out)
    assert np.allclose(t[9], t[8] @ rows[9][4])
    assert not PG.solve(frame(rows[:3]), 4)["solved"].any()


def test_bad_factors_are_refused():
    _, rows = graph(3, 0.0)
    with pytest.raises(ValueError, match="before any prior"):
        PG.solve(frame(rows[1:]))
    with pytest.raises(ValueError, match="already"):
        PG.solve(frame([*rows, rows[-1]]))
