"""Robust statistics, error reports and trajectory metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import geometry as G
from cairn.operators import solvers as S

#: Success thresholds of the reports: translation in metres, rotation in degrees (fixed values).
THRESHOLDS = ((0.3, 15.0), (0.6, 1.5), (2.0, 5.0))
#: Lengths in metres and start step of segment errors, and the factor that stands for a half turn there (fixed values).
LENGTHS, STEP, HALF_TURN = tuple(range(100, 801, 100)), 10, 3.14


def median_mad(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """AG6: exact median and 1.4826 * median absolute deviation of each group; null for a group without values."""
    middle = rows.groupBy(*by).agg(F.median(value).alias("median"))
    joined = rows.join(middle, list(by)) if by else rows.crossJoin(F.broadcast(middle))
    return joined.groupBy(*by, "median").agg((1.4826 * F.median(F.abs(F.col(value) - F.col("median")))).alias("mad"))


def mad_inliers(rows: DataFrame, value: str, *by: str, factor: float = 1.5) -> DataFrame:
    """PR13: rows strictly within factor * MAD of the median; none where the MAD is 0."""
    stats = median_mad(rows, value, *by)
    joined = rows.join(stats, list(by)) if by else rows.crossJoin(F.broadcast(stats))
    return joined.filter(F.abs(F.col(value) - F.col("median")) < factor * F.col("mad"))


def error_summary(errors: DataFrame, *by: str) -> DataFrame:
    """AG5: mean and population deviation."""
    return errors.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("rte", "rre") for n, f in (("mean", F.avg), ("std", F.stddev_pop))], F.count("*").alias("n"))


def recall(errors: DataFrame, *by: str) -> DataFrame:
    """AG7, PR15: percentage of rows below both thresholds, for each pair of them."""
    return errors.groupBy(*by).agg(*[(100 * F.avg(((F.col("rte") < t) & (F.col("rre") < r)).cast("double"))).alias(f"recall_{i}") for i, (t, r) in enumerate(THRESHOLDS)])


def success_only(errors: DataFrame, *by: str, threshold: tuple[float, float] = THRESHOLDS[0]) -> DataFrame:
    """AG8: the means over successes alone."""
    good = (F.col("rte") < threshold[0]) & (F.col("rre") < threshold[1])
    return errors.groupBy(*by).agg(F.avg(F.when(good, F.col("rte"))).alias("rte"), F.avg(F.when(good, F.col("rre"))).alias("rre"), F.count_if(good).alias("n"))


def running_sigma(rows: DataFrame, key: str, order: str, error: str, min_motion: float, initial: float) -> DataFrame:
    """AG11: root mean square of the errors over min_motion so far, this row's too; initial before the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    moved = F.when(F.col(error) > min_motion, F.col(error))
    n = F.count(moved).over(w)
    return rows.withColumn("sigma", F.when(n > 0, F.sqrt(F.sum(moved * moved).over(w) / n)).otherwise(initial))


def travelled(trajectory: DataFrame, key: str, order: str) -> DataFrame:
    """AG12, WN2: distance along (tx, ty, tz) from the start."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in ("tx", "ty", "tz")), F.lit(0.0)))
    stepped = trajectory.withColumn("_s", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("dist", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def segments(trajectory: DataFrame, key: str, order: str, lengths=LENGTHS, step: int = STEP) -> DataFrame:
    """WN3: for each step-th pose and each length the first later pose strictly farther along: (key, first, length, last).

    Poses and the distances asked for lie on one line by distance; a window from its far end hands
    each question the pose behind it. n log n, and no pose meets another.
    """
    way = travelled(trajectory, key, order).select(key, F.col(order).alias("pose"), "dist")
    asked = way.filter(F.col("pose") % step == 0).withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths])))
    none = F.lit(None)
    line = way.select(key, F.col("dist").alias("at"), "pose", none.cast("long").alias("first"), none.cast("int").alias("length"))
    line = line.unionByName(asked.select(key, (F.col("dist") + F.col("length")).alias("at"), none.cast("long").alias("pose"), F.col("pose").alias("first"), "length"))
    # Of equal distances a question comes behind the poses, so that they are not strictly farther.
    back = Window.partitionBy(key).orderBy(F.desc("at"), F.col("pose").isNotNull(), F.desc("pose")).rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("last", F.last("pose", ignorenulls=True).over(back))
    return found.filter("first IS NOT NULL AND last IS NOT NULL").select(key, "first", "length", "last")


def _poses_at(poses: DataFrame, key: str, order: str, prefix: str, at: str) -> DataFrame:
    return poses.select(key, F.col(order).alias(at), *[F.col(c).alias(prefix + c) for c in G.NAMES])


def segment_errors(truth: DataFrame, estimate: DataFrame, key: str, order: str) -> DataFrame:
    """AG9: mean translation error in percent and rotation error in degrees a metre, by 3.14 for a half turn, of each sequence."""
    out = segments(truth, key, order)
    for poses, name in ((truth, "t"), (estimate, "e")):
        for at in ("first", "last"):
            out = out.join(_poses_at(poses, key, order, f"{name}_{at}_", at), [key, at])
    moved = {name: G.relative(G.pose(f"{name}_first_"), G.pose(f"{name}_last_")) for name in "te"}
    off = G.relative(moved["e"], moved["t"])
    out = out.select(key, (G.distance(G.identity(), off) / F.col("length")).alias("t"), (G.angle(off) / F.col("length")).alias("r"))
    return out.groupBy(key).agg((100 * F.avg("t")).alias("terr"), (F.avg("r") / HALF_TURN * 180).alias("rerr"), F.count("*").alias("n"))


def alignment(truth: DataFrame, estimate: DataFrame, key: str, order: str) -> DataFrame:
    """AG4: (key, pose) that takes the places of estimate to those of truth with the least squares; sums in Spark, one 3 x 3 SVD for each key."""
    both = truth.select(key, order, *[F.col(c) for c in ("tx", "ty", "tz")]).join(estimate.select(key, order, *[F.col(c).alias(f"s{c[1]}") for c in ("tx", "ty", "tz")]), [key, order])
    means = both.groupBy(key).agg(*[F.avg(f"{side}{a}").alias(f"m{side}{a}") for side in "st" for a in "xyz"])
    centred = both.join(means, key)
    d = {f"{side}{a}": F.col(f"{side}{a}") - F.col(f"m{side}{a}") for side in "st" for a in "xyz"}
    sums = centred.groupBy(key, *[f"m{side}{a}" for side in "st" for a in "xyz"]).agg(*[F.sum(d[f"s{a}"] * d[f"t{b}"]).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"])
    kind = truth.schema[key].dataType.simpleString()

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h = f[[f"h{a}{b}" for a in "xyz" for b in "xyz"]].to_numpy().reshape(-1, 3, 3)
            r = S.turns(h)
            t = f[["mtx", "mty", "mtz"]].to_numpy() - np.einsum("nij,nj->ni", r, f[["msx", "msy", "msz"]].to_numpy())
            yield pd.DataFrame({key: f[key]} | dict(zip(S.POSE_COLUMNS, [*r.reshape(-1, 9).T, *t.T], strict=True)))

    return sums.mapInPandas(solve, f"{key} {kind}, {S.POSE_SCHEMA}")


def absolute_errors(truth: DataFrame, estimate: DataFrame, key: str, order: str) -> DataFrame:
    """AG10: root mean square rotation (radians) and translation error of each sequence after alignment."""
    align = alignment(truth, estimate, key, order).select(key, *[F.col(c).alias(f"a_{c}") for c in G.NAMES])
    both = truth.select(key, order, *G.NAMES).join(estimate.select(key, order, *[F.col(c).alias(f"e_{c}") for c in G.NAMES]), [key, order]).join(align, key)
    placed = G.compose(G.pose("a_"), G.pose("e_"))
    truth_pose = G.pose()
    turn = G.compose({c: v if c[0] == "r" else F.lit(0.0) for c, v in truth_pose.items()}, G.inverse({c: v if c[0] == "r" else F.lit(0.0) for c, v in placed.items()}))
    moved = G.apply(turn, placed["tx"], placed["ty"], placed["tz"])
    off = sum(((truth_pose[c] - m) * (truth_pose[c] - m) for c, m in zip(("tx", "ty", "tz"), moved, strict=True)), F.lit(0.0))
    angle = G.angle(turn)
    return both.groupBy(key).agg(F.sqrt(F.avg(angle * angle)).alias("rotation"), F.sqrt(F.avg(off)).alias("translation"), F.count("*").alias("n"))


def mean_similarity(matches: DataFrame, sim: str = "sim") -> DataFrame:
    """AG20: the mean over all queries, those below any gate too."""
    return matches.agg(F.avg(sim).alias("mean"), F.count("*").alias("n"))


def mean_by_metric(results: DataFrame) -> DataFrame:
    """AG22: the mean of each metric over sequences, from (seq, metric, value)."""
    return results.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def largest_cell(rows: DataFrame, r: str, c: str, value: str, *by: str) -> DataFrame:
    """AG23: row and column of the largest value; of equal ones the first by row and column."""
    best = rows.groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(r)).alias("r"), (-F.col(c)).alias("c"))).alias("m"))
    return best.select(*by, (-F.col("m.r")).alias(r), (-F.col("m.c")).alias(c), F.col("m.v").alias(value))


def k_max(values: DataFrame, key: str, dim: str, value: str, k: int) -> DataFrame:
    """AG15: the k largest values of each (key, dim), by rank; k = 1 is max-pooling."""
    w = Window.partitionBy(key, dim).orderBy(F.desc(value))
    return values.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def seeds(rows: DataFrame, key: str, score: str, order: str, share: float = 0.1) -> DataFrame:
    """TK4: the int(n * share) rows of best score of each key."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"_n": F.row_number().over(w.orderBy(F.desc(score), order)), "_all": F.count("*").over(w)})
    return ranked.filter(F.col("_n") <= F.floor(F.col("_all") * share)).drop("_n", "_all")


def report_lines(errors: DataFrame) -> DataFrame:
    """SK6: a line of mean, deviation and recall of each method, from method, rte, rre and success."""
    out = errors.groupBy("method").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("rte", "rre") for n, f in (("mean", F.avg), ("std", F.stddev_pop))], (100 * F.avg(F.col("success").cast("double"))).alias("recall")
    )
    pair = [F.format_string("%.2f$\\pm$%.2f", F.col(f"mean_{c}"), F.col(f"std_{c}")) for c in ("rte", "rre")]
    return out.select("method", F.concat_ws(" & ", F.concat(F.col("method"), F.lit("\t"), pair[0]), pair[1], F.format_string("%.2f", "recall")).alias("line"))


def latency(frames: DataFrame, seconds: str) -> DataFrame:
    """AG21: whole frames a second, and whole milliseconds for a frame at that rate."""
    out = frames.agg(F.ceil(F.count("*") / F.sum(seconds)).alias("fps"))
    return out.withColumn("ms", F.ceil(1000 / F.col("fps")))
