"""IT11: poses of a graph of priors, odometry steps and loop closures, by Gauss-Newton.

A graph is one trajectory and is solved in one task, in memory that grows with its factors. The
linear systems are solved by conjugate gradients; the chain of priors and odometry, factored
block by block, is the preconditioner, so that each loop adds six rounds at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cairn.operators.solvers import POSE_COLUMNS, POSE_SCHEMA, se3_exp

#: Precision of a prior (a fixed value).
PRIOR = 1e6

Factor = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def hats(v: np.ndarray) -> np.ndarray:
    """Cross-product matrices of vectors."""
    out = np.zeros((*v.shape[:-1], 3, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    return out - np.swapaxes(out, -1, -2)


def inverses(t: np.ndarray) -> np.ndarray:
    out = np.zeros_like(t)
    out[:, :3, :3] = np.swapaxes(t[:, :3, :3], 1, 2)
    out[:, :3, 3] = -np.einsum("nij,nj->ni", out[:, :3, :3], t[:, :3, 3])
    out[:, 3, 3] = 1
    return out


def logs(t: np.ndarray) -> np.ndarray:
    """Twists of poses whose angles are below half a turn, translation first."""
    r = t[:, :3, :3]
    axis = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], 1) / 2
    sine = np.linalg.norm(axis, axis=1)
    angle = np.arctan2(sine, (np.trace(r, axis1=1, axis2=2) - 1) / 2)
    small = angle < 1e-6
    w = axis * np.where(small, 1.0, angle / np.where(small, 1.0, sine))[:, None]
    a = np.where(small, 1.0, angle)
    c = np.where(small, 1 / 12, 1 / a**2 - 1 / (2 * a * np.tan(a / 2)))
    h = hats(w)
    v = np.eye(3) - h / 2 + c[:, None, None] * h @ h
    return np.concatenate([np.einsum("nij,nj->ni", v, t[:, :3, 3]), w], 1)


def _jacobians(poses: np.ndarray, i: np.ndarray, j: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals log(z^-1 Ti^-1 Tj) and their derivatives by right-hand twists of Ti and Tj; i = -1 stands for the identity."""
    start = np.where((i < 0)[:, None, None], np.eye(4), poses[i])
    between = inverses(start) @ poses[j]
    e = logs(inverses(z) @ between)
    small = np.zeros((len(e), 6, 6))
    small[:, :3, :3] = small[:, 3:, 3:] = hats(e[:, 3:])
    small[:, :3, 3:] = hats(e[:, :3])
    by_j = np.eye(6) + small / 2 + small @ small / 12
    back = inverses(between)
    adjoint = np.zeros_like(small)
    adjoint[:, :3, :3] = adjoint[:, 3:, 3:] = back[:, :3, :3]
    adjoint[:, :3, 3:] = hats(back[:, :3, 3]) @ back[:, :3, :3]
    by_i = -by_j @ adjoint
    by_i[i < 0] = 0
    return e, by_i, by_j


def cost(poses: np.ndarray, factors: Factor) -> float:
    i, j, z, weight = factors
    return float(weight @ (_jacobians(poses, i, j, z)[0] ** 2).sum(1))


class _Chain:
    """Block-tridiagonal matrix of the factors between neighbours."""

    def __init__(self, n: int, i, j, by_i, by_j, weight) -> None:
        self.diagonal, self.above = np.zeros((n, 6, 6)), np.zeros((n, 6, 6))
        wi, wj = np.swapaxes(by_i, 1, 2) * weight[:, None, None], np.swapaxes(by_j, 1, 2) * weight[:, None, None]
        inner = i >= 0
        np.add.at(self.diagonal, j, wj @ by_j)
        np.add.at(self.diagonal, i[inner], (wi @ by_i)[inner])
        np.add.at(self.above, i[inner], (wi @ by_j)[inner])
        self.inverse, self.lower = np.zeros((n, 6, 6)), np.zeros((n, 6, 6))
        self.inverse[0] = np.linalg.inv(self.diagonal[0])
        for k in range(1, n):
            self.lower[k] = self.above[k - 1].T @ self.inverse[k - 1]
            self.inverse[k] = np.linalg.inv(self.diagonal[k] - self.lower[k] @ self.above[k - 1])

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for k in range(1, len(x)):
            x[k] -= self.lower[k] @ x[k - 1]
        x = np.einsum("nij,nj->ni", self.inverse, x)
        for k in range(len(x) - 2, -1, -1):
            x[k] -= self.lower[k + 1].T @ x[k + 1]
        return x


def _step(poses: np.ndarray, factors: Factor, rounds: int) -> np.ndarray:
    """Twists (n, 6) that the linearised factors ask for."""
    i, j, z, weight = factors
    e, by_i, by_j = _jacobians(poses, i, j, z)
    inner = i >= 0

    def gathered(r: np.ndarray) -> np.ndarray:
        out, r = np.zeros((len(poses), 6)), r * weight[:, None]
        np.add.at(out, j, np.einsum("nji,nj->ni", by_j, r))
        np.add.at(out, i[inner], np.einsum("nji,nj->ni", by_i, r)[inner])
        return out

    near = ~inner | (j == i + 1)
    chain = _Chain(len(poses), i[near], j[near], by_i[near], by_j[near], weight[near])
    r = -gathered(e)
    x, y = np.zeros_like(r), chain.solve(r)
    p, was = y, float((r * y).sum())
    first = was
    for _ in range(rounds):
        if was <= 1e-16 * first:
            break
        hp = gathered(np.einsum("nij,nj->ni", by_i, p[i]) + np.einsum("nij,nj->ni", by_j, p[j]))
        a = was / float((p * hp).sum())
        x, r = x + a * p, r - a * hp
        y = chain.solve(r)
        now = float((r * y).sum())
        p, was = y + now / was * p, now
    return x


def optimise(poses: np.ndarray, factors: Factor, rounds: int = 50, stop: float = 1e-9) -> np.ndarray:
    """Poses (n, 4, 4) of least cost near the given ones; a step that doesn't lower the cost is halved."""
    least = cost(poses, factors)
    loops = int(((factors[0] >= 0) & (factors[1] != factors[0] + 1)).sum())
    for _ in range(rounds):
        if least < 1e-18:
            break  # nothing to gain, and no need to factor
        step = _step(poses, factors, 6 * loops + 12)
        if np.abs(step).max() < stop:
            break
        for half in range(12):
            moved = poses @ np.stack([se3_exp(v) for v in step * 0.5**half])
            now = cost(moved, factors)
            if now < least:
                break
        else:
            return poses
        poses, least = moved, now
    return poses


def updates(kinds: list[str], at_least: int = 1) -> list[bool]:
    """After which factors the graph is solved: while one loop is new, or when at_least factors are."""
    out, new, loops = [], 0, 0
    for kind in kinds:
        new += 1
        loops += kind == "loop"
        early = loops == 1
        out.append(early or new >= at_least)
        if out[-1]:
            new, loops = 0, loops if early else 0
    return out


def solve(rows: pd.DataFrame, at_least: int = 1) -> pd.DataFrame:
    """vertex, solved and pose for the factors of one graph in order.

    Vertices that come after the last update go on from the one before them by their measurements.
    """
    flat = rows[POSE_COLUMNS].to_numpy(np.float64)
    z = np.tile(np.eye(4), (len(rows), 1, 1))
    z[:, :3, :3], z[:, :3, 3] = flat[:, :9].reshape(-1, 3, 3), flat[:, 9:]
    kinds = rows["kind"].tolist()
    last = max((k + 1 for k, u in enumerate(updates(kinds, at_least)) if u), default=0)
    place: dict[int, int] = {}
    poses, i, j, weight = [], [], [], []
    for k, (kind, src, dst, sigma) in enumerate(zip(kinds, rows["src"], rows["dst"], rows["sigma"], strict=True)):
        if k == last and k:
            poses = list(optimise(np.stack(poses), (np.array(i), np.array(j), z[:k], np.array(weight))))
            solved = len(poses)
        if kind in ("prior", "odom"):
            if int(dst) in place:
                raise ValueError(f"vertex {dst} is there already")
            if kind == "odom" and not poses:
                raise ValueError("odometry before any prior")
            i.append(-1 if kind == "prior" else len(poses) - 1)
            place[int(dst)] = len(poses)
            poses.append(z[k] if kind == "prior" else poses[-1] @ z[k])
        elif kind == "loop":
            i.append(place[int(src)])
        else:
            raise ValueError(f"a factor is a prior, odom or loop, not {kind}")
        j.append(place[int(dst)])
        weight.append(PRIOR if kind == "prior" else 1 / float(sigma) ** 2)
    if last == len(rows):
        poses = list(optimise(np.stack(poses), (np.array(i), np.array(j), z, np.array(weight))))
        solved = len(poses)
    elif not last:
        solved = 0
    out = pd.DataFrame([[*p[:3, :3].ravel(), *p[:3, 3]] for p in poses], columns=POSE_COLUMNS)
    out.insert(0, "solved", np.arange(len(poses)) < solved)
    out.insert(0, "vertex", list(place))
    return out


def pose_graph(factors: DataFrame, key: str, order: str, at_least: int = 1) -> DataFrame:
    """IT11: (key, vertex, solved, pose) for factors (key, order, kind, src, dst, sigma, pose).

    kind: `prior` (pose of a new vertex dst; src and sigma are not read), `odom` (dst is new, its
    pose seen from the newest vertex; src is not read) or `loop` (pose of dst seen from src, both
    there). All factors are linearised anew in each round.
    """
    kind = factors.schema[key].dataType.simpleString()

    def one(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = solve(rows.sort_values(order, kind="stable"), at_least)
        out.insert(0, key, name[0])
        return out

    return factors.groupBy(key).applyInPandas(one, f"{key} {kind}, vertex long, solved boolean, {POSE_SCHEMA}")
