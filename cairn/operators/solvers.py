"""Iterative registration: sums in Spark where data is large, numpy within a group where it iterates."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSE_COLUMNS = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]
POSE_SCHEMA = ", ".join(f"{c} double" for c in POSE_COLUMNS)


def pose_row(t: np.ndarray) -> dict[str, float]:
    return dict(zip(POSE_COLUMNS, [*t[:3, :3].ravel(), *t[:3, 3]], strict=True))


def se3_exp(v: np.ndarray) -> np.ndarray:
    """Pose of a twist, translation first."""
    w, angle = v[3:], float(np.linalg.norm(v[3:]))
    hat = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-9:
        a, b, c = 1.0, 0.5, 1 / 6
    else:
        a, b, c = np.sin(angle) / angle, (1 - np.cos(angle)) / angle**2, (angle - np.sin(angle)) / angle**3
    out = np.eye(4)
    out[:3, :3] += a * hat + b * hat @ hat
    out[:3, 3] = (np.eye(3) + b * hat + c * hat @ hat) @ v[:3]
    return out


def orthogonal(r: np.ndarray, rounds: int = 50) -> np.ndarray:
    """SE9: the nearest rotation, by r <- 1.5 r - 0.5 r r^T r."""
    for _ in range(rounds):
        if abs(1 - np.linalg.det(r)) <= 1e-12:
            break
        r = 1.5 * r - 0.5 * r @ r.T @ r
    return r


def rigid(a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """AG3, AG4: pose that takes points a to b with the least weighted squares."""
    w = np.ones(len(a)) if weights is None else weights
    w = w / (w.sum() + 1e-6)
    ca, cb = w @ a, w @ b
    u, _, vt = np.linalg.svd((a - ca).T @ ((b - cb) * w[:, None]))
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    out = np.eye(4)
    out[:3, :3] = vt.T @ d @ u.T
    out[:3, 3] = cb - out[:3, :3] @ ca
    return out


def normal_equations(pairs: DataFrame, kernel: float, *by: str) -> DataFrame:
    """AG1: sums of J^T W J (upper half, h<i><j>) and J^T W r (g<i>) over pairs (sx, sy, sz, tx, ty, tz); one row for each group."""
    s, t = [F.col(f"s{a}") for a in "xyz"], [F.col(f"t{a}") for a in "xyz"]
    r = [a - b for a, b in zip(s, t, strict=True)]
    w = F.lit(kernel * kernel) / F.pow(kernel + r[0] * r[0] + r[1] * r[1] + r[2] * r[2], F.lit(2.0))
    one, none = F.lit(1.0), F.lit(0.0)
    j = [[one, none, none, none, s[2], -s[1]], [none, one, none, -s[2], none, s[0]], [none, none, one, s[1], -s[0], none]]
    sums = [F.sum(w * (j[0][a] * j[0][b] + j[1][a] * j[1][b] + j[2][a] * j[2][b])).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)]
    sums += [F.sum(w * (j[0][a] * r[0] + j[1][a] * r[1] + j[2][a] * r[2])).alias(f"g{a}") for a in range(6)]
    return pairs.groupBy(*by).agg(*sums)


def solve_step(row) -> np.ndarray:
    """AG2: the pose of one Gauss-Newton step from a row of normal_equations()."""
    h = np.zeros((6, 6))
    for a in range(6):
        for b in range(a, 6):
            h[a, b] = h[b, a] = row[f"h{a}{b}"]
    return se3_exp(np.linalg.lstsq(h, -np.array([row[f"g{a}"] for a in range(6)]), rcond=None)[0])


class CellMap:
    """Points by truncated voxel: the first `cap` of each; nearest within the 27 cells around a point.

    A point is a row of x, y, z and, where all have one, its descriptor.
    """

    def __init__(self, size: float, cap: int = 20) -> None:
        self.size, self.cap, self.width = size, cap, 3
        self.cells: dict[tuple[int, int, int], list[np.ndarray]] = {}

    def keys(self, p: np.ndarray) -> np.ndarray:
        return np.trunc(p[:, :3] / self.size).astype(np.int64)

    def add(self, p: np.ndarray) -> None:
        self.width = p.shape[1]
        for key, x in zip(map(tuple, self.keys(p).tolist()), p, strict=True):
            cell = self.cells.setdefault(key, [])
            if len(cell) < self.cap:
                cell.append(x)

    def evict(self, origin: np.ndarray, far: float) -> None:
        self.cells = {k: c for k, c in self.cells.items() if np.sum((c[0][:3] - origin) ** 2) <= far * far}

    def points(self) -> np.ndarray:
        return np.array([x for c in self.cells.values() for x in c]).reshape(-1, self.width)

    def nearest(self, p: np.ndarray, far: float, desc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places in p that have a match nearer than far, and the matches; with descriptors of p ranked as JN3 does."""
        places, found = [], []
        known: dict[tuple[int, int, int], np.ndarray] = {}
        for n, (key, x) in enumerate(zip(map(tuple, self.keys(p).tolist()), p, strict=True)):
            if key not in known:
                i, j, k = key
                known[key] = np.array([q for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for c in (k - 1, k, k + 1) for q in self.cells.get((a, b, c), ())]).reshape(-1, self.width)
            around = known[key]
            if len(around):
                d2 = ((around[:, :3] - x) ** 2).sum(1)
                best = int((d2 if desc is None else d2 * unlikeness(desc[n], around[:, 3:])).argmin())
                if d2[best] < far * far:
                    places.append(n)
                    found.append(around[best, :3])
        return np.array(places, np.int64), np.array(found).reshape(-1, 3)


def unlikeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half of 1 - cosine of a descriptor and each of b, from 0.01 to 1; 1 where one of the two sums to zero."""
    cosine = b @ a / (np.linalg.norm(a) * np.linalg.norm(b, axis=1) + 1e-5)
    return np.where((a.sum() != 0) & (b.sum(1) != 0), np.clip(0.5 * (1 - cosine), 0.01, 1.0), 1.0)


def downsample(p: np.ndarray, size: float) -> np.ndarray:
    """First point of each truncated voxel, in input order; columns beyond x, y, z stay."""
    _, first = np.unique(np.trunc(p[:, :3] / size).astype(np.int64), axis=0, return_index=True)
    return p[np.sort(first)]


def moved(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    return p @ t[:3, :3].T + t[:3, 3]


def icp(source: np.ndarray, target: CellMap, guess: np.ndarray, far: float, kernel: float, rounds: int = 1000, stop: float = 1e-4) -> np.ndarray:
    """IT1, IT10: pose of source in target; the guess for an empty map or when nothing is near.

    IT3: where source has descriptors beside x, y, z, as target then must, matches are ranked with them.
    """
    if not target.cells:
        return guess
    desc = source[:, 3:] if source.shape[1] > 3 else None
    p, out = moved(source[:, :3], guess), guess
    for _ in range(rounds):
        places, t = target.nearest(p, far, desc)
        if not len(places):
            break
        s = p[places]
        r = s - t
        w = kernel**2 / (kernel + (r**2).sum(1)) ** 2
        j = np.zeros((len(s), 3, 6))
        j[:, 0, 0] = j[:, 1, 1] = j[:, 2, 2] = 1
        j[:, 0, 4], j[:, 0, 5], j[:, 1, 3] = s[:, 2], -s[:, 1], -s[:, 2]
        j[:, 1, 5], j[:, 2, 3], j[:, 2, 4] = s[:, 0], s[:, 1], -s[:, 0]
        h = np.einsum("nia,n,nib->ab", j, w, j)
        g = np.einsum("nia,n,ni->a", j, w, r)
        dx = np.linalg.lstsq(h, -g, rcond=None)[0]
        step = se3_exp(dx)
        p, out = moved(p, step), step @ out
        if np.linalg.norm(dx) < stop:
            break
    return out


def turns(h: np.ndarray) -> np.ndarray:
    """Rotations of least squares from sums h (n, 3, 3) of s t^T."""
    u, _, vt = np.linalg.svd(h)
    v = np.swapaxes(vt, 1, 2).copy()
    v[:, :, 2] *= np.sign(np.linalg.det(v @ np.swapaxes(u, 1, 2)))[:, None]
    return v @ np.swapaxes(u, 1, 2)


def agreement(a: np.ndarray, b: np.ndarray, r: np.ndarray, t: np.ndarray, far: float, block: int = 1024) -> np.ndarray:
    """For each of the poses r (n, 3, 3), t (n, 3) the number of pairs it takes nearer than far, by blocks of pairs."""
    counts = np.zeros(len(r), np.int64)
    for i in range(0, len(a), block):
        p, q, d2 = np.ascontiguousarray(a[i : i + block].T), b[i : i + block], 0.0
        for axis in range(3):
            d = r[:, axis] @ p
            d += t[:, axis, None]
            d -= q[:, axis]
            d *= d
            d2 += d
        counts += np.count_nonzero(d2 < far * far, axis=1)
    return counts


def ransac(a: np.ndarray, b: np.ndarray, rounds: int = 50_000, far: float = 0.5, seed: int = 0, missed: float = 1e-12, block: int = 256) -> np.ndarray:
    """IT4: the pose from three pairs that most pairs agree with, refined over those.

    Triples are drawn and fitted in blocks, and pairs are counted in blocks, so that memory beyond the pairs is bounded. It ends after `rounds` of them, or when the chance that
    none of them was free of outliers, at the share of inliers found so far, is below `missed`.
    """
    rng = np.random.default_rng(seed)
    best, score, n = np.eye(4), -1, len(a)
    if n < 3:
        return best
    done, needed = 0, float(rounds)
    while done < min(rounds, needed):
        pick = rng.integers(0, n, (min(block, rounds - done), 3))
        done += len(pick)
        pick = pick[(pick[:, 0] != pick[:, 1]) & (pick[:, 0] != pick[:, 2]) & (pick[:, 1] != pick[:, 2])]
        if not len(pick):
            continue
        p, q = a[pick], b[pick]
        cp, cq = p.mean(1), q.mean(1)
        r = turns(np.einsum("nki,nkj->nij", p - cp[:, None], q - cq[:, None]))
        t = cq - np.einsum("nij,nj->ni", r, cp)
        counts = agreement(a, b, r, t, far)
        k = int(counts.argmax())
        if counts[k] > score:
            score, best = int(counts[k]), np.eye(4)
            best[:3, :3], best[:3, 3] = r[k], t[k]
            free = (score / n) ** 3
            needed = np.log(missed) / np.log1p(-free) if free < 1 else 0.0
    good = ((moved(a, best) - b) ** 2).sum(1) < far * far
    return rigid(a[good], b[good]) if good.sum() >= 3 else best


def refine(a: np.ndarray, b: np.ndarray, guess: np.ndarray, far: float = 0.1, rounds: int = 20) -> np.ndarray:
    """IT7: reweighted fits over the inliers until their number stays."""
    out, last = guess, -1
    for _ in range(rounds):
        d = np.sqrt(((moved(a, out) - b) ** 2).sum(1))
        good = d < far
        if good.sum() == last or good.sum() < 3:
            break
        last = int(good.sum())
        out = rigid(a[good], b[good], 1 / (1 + (d[good] / far) ** 2))
    return out


def robust_pairs(a: np.ndarray, b: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """IT2, first phase: fit, move, drop what is 1.5 MAD from the median, until the mean distance stays; pose and mask."""
    out, keep, mean = np.eye(4), np.ones(len(a), bool), np.inf
    for _ in range(rounds):
        if keep.sum() < 3:
            break
        out = rigid(a[keep], b[keep])
        d = np.sqrt(((moved(a, out) - b) ** 2).sum(1))
        middle = np.median(d[keep])
        mad = 1.4826 * np.median(np.abs(d[keep] - middle))
        near = keep & (np.abs(d - middle) < 1.5 * mad)
        now = d[keep].mean()
        if not near.any() or abs(now - mean) < 0.01:
            break
        keep, mean = near, now
    return out, keep


def farthest(p: np.ndarray, n: int) -> np.ndarray:
    """VX12: places of n points, each the farthest from those before; points within 1e-3 (squared) of the origin are skipped."""
    ok = (p**2).sum(1) > 1e-3
    out, near = np.zeros(n, np.int64), np.full(len(p), 1e10)
    for i in range(1, n):
        near = np.minimum(near, ((p - p[out[i - 1]]) ** 2).sum(1))
        out[i] = int(np.where(ok, near, -1).argmax())
    return out


def leading_vector(m: np.ndarray, rounds: int = 10) -> np.ndarray:
    """AG18: power iteration from ones, normalised each round."""
    v = np.ones(len(m))
    for _ in range(rounds):
        last = v
        v = m @ v
        v = v / (np.linalg.norm(v) + 1e-6)
        if np.allclose(v, last):
            break
    return v


def consistency(a: np.ndarray, b: np.ndarray, sigma: float) -> np.ndarray:
    """IT6: how well distances between pairs agree, 0 to 1."""
    da = np.sqrt(((a[:, None] - a) ** 2).sum(2))
    db = np.sqrt(((b[:, None] - b) ** 2).sum(2))
    return np.clip(1 - (da - db) ** 2 / sigma**2, 0, None)


def trajectory_error(truth: list[np.ndarray], estimate: list[np.ndarray]) -> tuple[float, float]:
    """AG10: root mean square rotation (radians) and translation errors after the best rigid alignment."""
    align = rigid(np.array([t[:3, 3] for t in estimate]), np.array([t[:3, 3] for t in truth]))
    turn, way = [], []
    for t, e in zip(truth, estimate, strict=True):
        e = align @ e
        r = t[:3, :3] @ e[:3, :3].T
        turn.append(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1)) ** 2)
        way.append(np.sum((t[:3, 3] - r @ e[:3, 3]) ** 2))
    return float(np.sqrt(np.mean(turn))), float(np.sqrt(np.mean(way)))


def se3_log(t: np.ndarray) -> np.ndarray:
    """Twist of a pose whose angle is below half a turn, translation first."""
    angle = float(np.arccos(np.clip((np.trace(t[:3, :3]) - 1) / 2, -1, 1)))
    k = 0.5 if angle < 1e-9 else angle / (2 * np.sin(angle))
    w = k * np.array([t[2, 1] - t[1, 2], t[0, 2] - t[2, 0], t[1, 0] - t[0, 1]])
    hat = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    c = 1 / 12 if angle < 1e-6 else 1 / angle**2 - 1 / (2 * angle * np.tan(angle / 2))
    return np.r_[(np.eye(3) - hat / 2 + c * hat @ hat) @ t[:3, 3], w]


def deskewed(points: np.ndarray, rel: np.ndarray, start: np.ndarray, finish: np.ndarray) -> np.ndarray:
    """WN8: points moved by the share of the motion between their time (0 to 1) and the middle of the scan."""
    twist = se3_log(np.linalg.inv(start) @ finish)
    times, of = np.unique(rel, return_inverse=True)
    poses = np.stack([se3_exp((x - 0.5) * twist) for x in times])[of]
    return np.einsum("nij,nj->ni", poses[:, :3, :3], points) + poses[:, :3, 3]


class Odometry:
    """IT8: one sequence, a frame at a time; the map is bounded by distance, the rest by constants.

    update: WN5, the motion below which a frame leaves map, poses and threshold as they are, once two poses are there.
    """

    def __init__(self, voxel: float = 1.0, low: float = 5.0, high: float = 100.0, cap: int = 20, min_motion: float = 0.1, sigma: float = 2.0, update: float = 0.0) -> None:
        self.voxel, self.low, self.high, self.min_motion, self.sigma, self.update = voxel, low, high, min_motion, sigma, update
        self.map = CellMap(voxel, cap)
        self.first = self.last = self.before = None
        self.deviation, self.sse, self.n = np.eye(4), 0.0, 0

    def threshold(self) -> float:
        if self.first is None or np.linalg.norm((np.linalg.inv(self.first) @ self.last)[:3, 3]) <= 5 * self.min_motion:
            return self.sigma
        angle = np.arccos(np.clip((np.trace(self.deviation[:3, :3]) - 1) / 2, -1, 1))
        error = np.linalg.norm(self.deviation[:3, 3]) + 2 * self.high * np.sin(angle / 2)
        if error > self.min_motion:
            self.sse, self.n = self.sse + error**2, self.n + 1
        return float(np.sqrt(self.sse / self.n)) if self.n else self.sigma

    def register(self, points: np.ndarray, rel: np.ndarray | None = None) -> np.ndarray:
        """The pose of a frame; rel: times of its points within the scan, to be deskewed by the motion before it."""
        if rel is not None and self.before is not None:
            points = deskewed(points, rel, self.before, self.last)
        d = np.linalg.norm(points, axis=1)
        kept = points[(d > self.low) & (d < self.high)]
        fine = downsample(kept, 0.5 * self.voxel)
        coarse = downsample(fine, 1.5 * self.voxel)
        sigma = self.threshold()
        motion = np.linalg.inv(self.before) @ self.last if self.before is not None else np.eye(4)
        guess = (self.last if self.last is not None else np.eye(4)) @ motion
        pose = icp(coarse, self.map, guess, 3 * sigma, sigma / 3)
        if self.before is not None and np.linalg.norm((np.linalg.inv(self.last) @ pose)[:3, 3]) < self.update:
            return pose
        self.deviation = np.linalg.inv(guess) @ pose
        self.map.add(moved(fine, pose))
        self.map.evict(pose[:3, 3], self.high)
        self.before, self.last = self.last, pose
        self.first = pose if self.first is None else self.first
        return pose


def xyz(frame: pd.DataFrame, prefix: str = "") -> np.ndarray:
    return frame[[prefix + c for c in "xyz"]].to_numpy(np.float64)


def odometry(points: DataFrame, seq: str = "seq_id", frame: str = "frame_id", rel: str | None = None, jump: int = 0, n_scans: int | None = None, **settings) -> DataFrame:
    """Poses of frames jump to jump + n_scans - 1 of each sequence from (seq, frame, pt_id, x, y, z); rel: the column of times for deskewing.

    The frames of a sequence follow each other in one task, which holds one frame and its map at a
    time, however long the sequence is.
    """
    from cairn.operators.points import frames_from

    columns = [seq, frame, "pt_id", "x", "y", "z", *([rel] if rel else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, parts = Odometry(**settings), None, []

        def done() -> pd.DataFrame:
            rows = pd.concat(parts)
            pose = state.register(xyz(rows), rows[rel].to_numpy(np.float64) if rel else None)
            return pd.DataFrame([{seq: now[0], frame: now[1]} | pose_row(pose)])

        for batch in batches:
            for key, part in batch.groupby([seq, frame], sort=False):
                if now is not None and key != now:
                    yield done()
                    if key[0] != now[0]:
                        state = Odometry(**settings)
                    parts = []
                now = key
                parts.append(part)
        if parts:
            yield done()

    rows = frames_from(points.select(*columns), frame, jump, n_scans)
    rows = rows.repartition(seq).sortWithinPartitions(seq, frame, "pt_id")
    return rows.mapInPandas(run, f"{seq} long, {frame} long, {POSE_SCHEMA}")


def pairwise(source: DataFrame, target: DataFrame, key: str, voxel: float = 1.0, sigma: float = 1.0, desc: str | None = None) -> DataFrame:
    """IT9: pose of each source cloud in the target cloud of the same key; with a column of descriptors by IT3."""

    def rows(f: pd.DataFrame) -> np.ndarray:
        f = f.sort_values("pt_id")
        return np.column_stack([xyz(f), np.stack(f[desc])]) if desc and len(f) else xyz(f)

    def run(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        grid = CellMap(voxel)
        grid.add(downsample(rows(b), 0.5 * voxel))
        cloud = downsample(downsample(rows(a), 0.5 * voxel), 1.5 * voxel)
        return pd.DataFrame([{key: k[0]} | pose_row(icp(cloud, grid, np.eye(4), 3 * sigma, sigma / 3))])

    columns = [key, "pt_id", "x", "y", "z", *([desc] if desc else [])]
    return source.select(*columns).groupBy(key).cogroup(target.select(*columns).groupBy(key)).applyInPandas(run, f"{key} long, {POSE_SCHEMA}")


def solve_groups(pairs: DataFrame, key: str, method: str = "kabsch", **settings) -> DataFrame:
    """Pose of each group of pairs (sx..sz to tx..tz): kabsch, ransac, robust (first phase of IT2) or consistent (IT6 with AG18)."""

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = xyz(rows.rename(columns={f"s{c}": c for c in "xyz"})), rows[["tx", "ty", "tz"]].to_numpy(np.float64)
        if method == "ransac":
            t = ransac(a, b, **settings)
        elif method == "robust":
            t = robust_pairs(a, b, **settings)[0]
        elif method == "consistent":
            w = leading_vector(consistency(a, b, settings.get("sigma", 1.0)))
            t = refine(a, b, rigid(a, b, w / max(w.sum(), 1e-9)), settings.get("far", 0.1))
        else:
            t = rigid(a, b)
        return pd.DataFrame([{key: k[0]} | pose_row(t)])

    ordered = pairs.select(key, "sx", "sy", "sz", "tx", "ty", "tz")
    return ordered.groupBy(key).applyInPandas(run, f"{key} long, {POSE_SCHEMA}")


def weighted_sums(pairs: DataFrame, weight: str, *by: str) -> DataFrame:
    """AG3: weighted centroids c<side><axis> (1e-6 in the denominators) and covariance h<axis><axis> of pairs (sx..sz to tx..tz)."""
    w = F.col(weight)
    total = F.sum(w) + 1e-6
    means = pairs.groupBy(*by).agg(*[(F.sum(w * F.col(f"{side}{a}")) / total).alias(f"c{side}{a}") for side in "st" for a in "xyz"])
    names = [f"c{side}{a}" for side in "st" for a in "xyz"]
    centred = pairs.join(means, list(by)) if by else pairs.crossJoin(F.broadcast(means))
    off = {f"{side}{a}": F.col(f"{side}{a}") - F.col(f"c{side}{a}") for side in "st" for a in "xyz"}
    return centred.groupBy(*by, *names).agg(*[F.sum(w * off[f"s{a}"] * off[f"t{b}"]).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"])


def local_axes(neighbours: DataFrame, key: str = "src_id") -> DataFrame:
    """AG16: the axis of least spread of the points around each centre, from rows (key, dx, dy, dz); it points to where most of them are not.

    Six sums for each centre in Spark, eigenvectors in numpy for a batch of centres.
    """
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = neighbours.groupBy(key).agg(*[F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"{a}{b}") for a, b in pairs], *[F.sum(f"d{a}").alias(f"s{a}") for a in "xyz"], F.count("*").alias("n"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            c = np.zeros((len(f), 3, 3))
            for a, b in pairs:
                i, j = "xyz".index(a), "xyz".index(b)
                c[:, i, j] = c[:, j, i] = f[f"{a}{b}"] / 3
            values, vectors = np.linalg.eigh(c)
            z = vectors[:, :, 0]
            away = (z * f[["sx", "sy", "sz"]].to_numpy()).sum(1) > 0
            z = np.where(away[:, None], -z, z)
            yield pd.DataFrame({key: f[key], "nx": z[:, 0], "ny": z[:, 1], "nz": z[:, 2], "least": values[:, 0], "most": values[:, 2]})

    return sums.mapInPandas(solve, f"{key} long, nx double, ny double, nz double, least double, most double")


def principal_colours(rows: DataFrame, key: str, desc: str, n: int = 3) -> DataFrame:
    """AG17: descriptors projected to their first n principal components, scaled to 0..255; a zero descriptor is black.

    The mean and the products are sums in Spark, whose number is the square of the descriptor's length.
    """
    from cairn.functions import vectors as V

    some = rows.filter(V.has_nonzero_sum(F.col(desc))).select(F.col(desc).alias("v"))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            x = np.stack(f["v"]).astype(np.float64) if len(f) else np.zeros((0, 1))
            if len(x):
                x = np.column_stack([x, np.ones(len(x))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    sums = some.mapInPandas(add, "i int, row array<double>")
    cells = sums.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    if not cells:
        return rows.select(key, F.array(*[F.lit(0)] * n).alias("colour"))
    width = 1 + max(r["i"] for r in cells)
    total = np.zeros((width, width))
    for r in cells:
        total[r["i"], r["j"]] = r["x"]
    count = total[-1, -1]
    mean = total[-1, :-1] / count
    _, vectors = np.linalg.eigh(total[:-1, :-1] / count - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, :n]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(n)])
    shift = mean @ axes
    made = [V.dot(F.col(desc), F.array(*[F.lit(float(x)) for x in axes[:, k]])) - float(shift[k]) for k in range(n)]
    placed = rows.select(key, V.has_nonzero_sum(F.col(desc)).alias("_some"), *[c.alias(f"_p{k}") for k, c in enumerate(made)])
    ends = placed.filter("_some").agg(*[f(f"_p{k}").alias(f"_{n_}{k}") for k in range(n) for n_, f in (("low", F.min), ("high", F.max))])
    wide = placed.crossJoin(F.broadcast(ends))
    scaled = [F.when(F.col("_some"), F.floor(255 * F.try_divide(F.col(f"_p{k}") - F.col(f"_low{k}"), F.col(f"_high{k}") - F.col(f"_low{k}")))).otherwise(0).cast("int") for k in range(n)]
    return wide.select(key, F.array(*scaled).alias("colour"))


def thinned_clusters(points: DataFrame, cluster: str, p: float, seed: int = 0) -> DataFrame:
    """IT13: all points of a cluster go with chance p, by a draw that its number and the seed decide; noise (-1) stays."""
    draw = (F.pmod(F.xxhash64(F.col(cluster), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)).cast("double")
    return points.filter((F.col(cluster) == -1) | (draw >= p))


def farthest_points(points: DataFrame, key: str, n: int) -> DataFrame:
    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pt_id").reset_index(drop=True)
        at = farthest(xyz(rows), min(n, len(rows)))
        return pd.DataFrame({key: k[0], "slot": np.arange(len(at)), "pt_id": rows["pt_id"].to_numpy()[at]})

    return points.select(key, "pt_id", "x", "y", "z").groupBy(key).applyInPandas(run, f"{key} long, slot long, pt_id long")


def icp_distributed(source: DataFrame, target: DataFrame, size: float, far: float, kernel: float, rounds: int = 1000, stop: float = 1e-4) -> np.ndarray:
    """IT1 for clouds beyond one executor: each round is a cell join and 27 sums; the driver holds one pose. Warns when rounds run out."""
    from cairn.operators.neighbours import nearest_in_cells
    from cairn.operators.points import transformed

    out = np.eye(4)
    for _ in range(rounds):
        now = transformed(source, {k: F.lit(float(v)) for k, v in pose_row(out).items()})
        match = nearest_in_cells(now, target, size, far)
        pairs = match.join(now.select(F.col("pt_id").alias("src_id"), *[F.col(c).alias(f"s{c}") for c in "xyz"]), "src_id").join(target.select(F.col("pt_id").alias("tgt_id"), *[F.col(c).alias(f"t{c}") for c in "xyz"]), "tgt_id")
        row = normal_equations(pairs, kernel).collect()[0]
        if row["g0"] is None:
            break
        step = solve_step(row)
        out = step @ out
        if np.linalg.norm(step - np.eye(4)) < stop:
            break
    else:
        warnings.warn(f"icp_distributed: not converged after {rounds} rounds", stacklevel=2)
    return out
