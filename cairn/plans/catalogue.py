"""Queries over the driver's tables, one for each operator, and SQL for what SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import geometry as G
from cairn.functions import vectors as V
from cairn.operators import metrics as M
from cairn.operators import neighbours as N
from cairn.operators import points as P
from cairn.operators import pose_graph as PG
from cairn.operators import solvers as S
from cairn.operators import temporal as T
from cairn.plans import views as W
from cairn.plans.views import r6, s6
from cairn.sources import scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_XYZ = f"{s6('x')} AS x, {s6('y')} AS y, {s6('z')} AS z"


def _xyz(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *[r6(F.col(c)).alias(c) for c in "xyz"])


# Descriptor search: the flagship.


@query(f"""WITH {W.DESCRIPTORS}, n AS (SELECT src_id, max(sim) AS sim, arg_max(tgt_id, (sim, -tgt_id)) AS tgt_id FROM ab GROUP BY src_id), g AS (SELECT *, 1 - sim AS d FROM n WHERE sim >= 0.3),
m AS (SELECT median(d) AS md FROM g), k AS (SELECT 1.4826 * median(abs(d - md)) AS mad FROM g, m)
SELECT src_id, tgt_id, {s6('sim')} AS sim FROM g, m, k WHERE abs(d - md) < 1.5 * mad""")
def descriptor_correspondences(spark, d):
    a, b = W.descriptors(spark, d)
    found = N.cosine_nearest(a, b, 0.3).withColumn("d", 1 - F.col("sim"))
    return M.mad_inliers(found, "d").select("src_id", "tgt_id", r6(F.col("sim")).alias("sim"))


# Filters and geometry.


@query(f"WITH {W.POINTS} SELECT pt_id, {_XYZ} FROM p WHERE sqrt(x*x + y*y + z*z) > 5 AND sqrt(x*x + y*y + z*z) < 40")
def range_crop(spark, d):
    return _xyz(P.range_crop(W.points(spark, d), 5, 40), "pt_id")


@query(f"WITH {W.POINTS} SELECT pt_id, {_XYZ} FROM p WHERE greatest(abs(x - 3), abs(y + 4)) < 12.5")
def square_crop(spark, d):
    return _xyz(P.square_crop(W.points(spark, d), F.lit(3.0), F.lit(-4.0), 12.5), "pt_id")


@query("""WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT label, CAST(count(*) FILTER (list_sum(v) <> 0) AS BIGINT) AS n_sum, CAST(count(*) FILTER (list_sum(v) > 0) AS BIGINT) AS n_positive, CAST(count(*) FILTER (len(list_filter(v, lambda x: x = 0)) = 0) AS BIGINT) AS n_all FROM e GROUP BY label""")
def has_descriptor(spark, d):
    v = F.col("embedding")
    return W.table(spark, d, "embeddings").groupBy("label").agg(F.count_if(V.has_nonzero_sum(v)).alias("n_sum"), F.count_if(V.has_positive_sum(v)).alias("n_positive"), F.count_if(V.has_no_zero(v)).alias("n_all"))


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, {s6('2 * v[1] / sqrt(list_inner_product(v, v))')} AS first, {s6('list_sum(v) / sqrt(list_inner_product(v, v))')} AS total FROM e""")
def l2_normalise(spark, d):
    n = W.table(spark, d, "embeddings").select("vec_id", V.normalised(F.transform("embedding", lambda x: x * 2)).alias("n"))
    return n.select("vec_id", r6(2 * F.col("n")[0]).alias("first"), r6(V.total(F.col("n"))).alias("total"))


_C, _S = math.cos(math.radians(0.205)), math.sin(math.radians(0.205))


@query(f"""WITH {W.POINTS}, f AS (SELECT *, nullif(sqrt(x*x + y*y), 0) AS h FROM p)
SELECT pt_id, {s6(f'coalesce(x * {_C!r} - x / h * z * {_S!r}, x)')} AS x, {s6(f'coalesce(y * {_C!r} - y / h * z * {_S!r}, y)')} AS y, {s6(f'coalesce(z * {_C!r} + h * {_S!r}, z)')} AS z FROM f""")
def axis_correction(spark, d):
    p = W.points(spark, d)
    x, y, z = G.tilt(F.col("x"), F.col("y"), F.col("z"), 0.205)
    return p.select("pt_id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query(f"""WITH {W.POSES}, {W.POINTS}, k AS (SELECT pt_id, x, y, z, (pt_id // 1000000000) // 10 AS o_orderkey FROM p)
SELECT pt_id, {s6('cos(yaw) * x - sin(yaw) * y + tx')} AS x, {s6('sin(yaw) * x + cos(yaw) * y + ty')} AS y, {s6('z')} AS z FROM k JOIN o USING (o_orderkey)""")
def rigid_transform(spark, d):
    poses = W.poses(spark, d)
    p = W.points(spark, d).withColumn("o_orderkey", F.expr("pt_id div 1000000000 div 10"))
    joined = p.join(poses, "o_orderkey")
    x, y, z = G.apply(W.pose_of(joined), F.col("x"), F.col("y"), F.col("z"))
    return joined.select("pt_id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query(f"""WITH {W.POSES}, q AS (SELECT o_orderkey, yaw, tx, ty, lag(yaw) OVER w AS y0, lag(tx) OVER w AS x0, lag(ty) OVER w AS z0 FROM o WINDOW w AS (PARTITION BY o_orderkey % 50 ORDER BY o_orderkey))
SELECT o_orderkey, {s6('cos(y0) * (tx - x0) + sin(y0) * (ty - z0)')} AS tx, {s6('-sin(y0) * (tx - x0) + cos(y0) * (ty - z0)')} AS ty, {s6('cos(yaw - y0)')} AS r00, {s6('sin(yaw - y0)')} AS r10 FROM q WHERE y0 IS NOT NULL""")
def relative_pose(spark, d):
    o = W.poses(spark, d)
    w = Window.partitionBy(F.col("o_orderkey") % 50).orderBy("o_orderkey")
    o = o.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("yaw", "tx", "ty", "tz")}).filter("p_yaw IS NOT NULL")
    before = G.from_euler(F.lit(0.0), F.lit(0.0), F.col("p_yaw")) | {c: F.col(f"p_{c}") for c in ("tx", "ty", "tz")}
    rel = G.relative(before, W.pose_of(o))
    return o.select("o_orderkey", *[r6(rel[c]).alias(c) for c in ("tx", "ty", "r00", "r10")])


@query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount AS roll, l_tax * 10 AS pitch, l_quantity / 10 AS yaw FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {s6('cos(yaw) * cos(pitch)')} AS r00, {s6('cos(yaw) * sin(pitch) * sin(roll) - sin(yaw) * cos(roll)')} AS r01, {s6('-sin(pitch)')} AS r20, {s6('cos(pitch) * cos(roll)')} AS r22, {s6('atan2(sin(pitch), sqrt(cos(pitch) * cos(pitch)))')} AS back FROM q""")
def euler_to_rotation(spark, d):
    li = W.table(spark, d, "lineitem")
    p = G.from_euler(F.col("l_discount"), F.col("l_tax") * 10, F.col("l_quantity") / 10)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", *[r6(p[c]).alias(c) for c in ("r00", "r01", "r20", "r22")], r6(G.to_euler(p)[1]).alias("back"))


@query(f"""WITH {W.POSES}, q AS (SELECT o_orderkey, CASE WHEN 2 + 2 * cos(yaw) >= 2 - 2 * cos(yaw) THEN sqrt(2 + 2 * cos(yaw)) / 2 ELSE 2 * sin(yaw) / (2 * sqrt(2 - 2 * cos(yaw))) END AS w,
CASE WHEN 2 + 2 * cos(yaw) >= 2 - 2 * cos(yaw) THEN 2 * sin(yaw) / (2 * sqrt(2 + 2 * cos(yaw))) ELSE sqrt(2 - 2 * cos(yaw)) / 2 END AS z FROM o)
SELECT o_orderkey, {s6('w')} AS w, {s6('z')} AS z FROM q""")
def quaternion(spark, d):
    o = W.poses(spark, d)
    w, _, _, z = G.quaternion(W.pose_of(o))
    return o.select("o_orderkey", r6(w).alias("w"), r6(z).alias("z"))


@query(f"""WITH {W.POSES} SELECT o_orderkey, floor(degrees(acos(greatest(least((1 + 2 * cos(yaw - 1) - 1) / 2, 1), -1))) * 1e3 + 0.5e0) / 1e3 AS rre, {s6('sqrt((tx - 3) * (tx - 3) + (ty - 4) * (ty - 4))')} AS rte FROM o""")
def pose_error(spark, d):
    o = W.poses(spark, d)
    truth = G.from_euler(F.lit(0.0), F.lit(0.0), F.lit(1.0)) | {"tx": F.lit(3.0), "ty": F.lit(4.0)}
    angle = G.rotation_degrees(truth, W.pose_of(o))
    return o.select("o_orderkey", (F.floor(angle * 1e3 + 0.5) / 1e3).alias("rre"), r6(G.distance(truth, W.pose_of(o))).alias("rte"))


@query(f"""WITH {W.POSES} SELECT o_orderkey, floor((sqrt(tx*tx + ty*ty) + 200 * sin(acos(greatest(least((1 + 2 * cos(yaw) - 1) / 2, 1), -1)) / 2)) * 1e3 + 0.5e0) / 1e3 AS err FROM o""")
def model_error(spark, d):
    o = W.poses(spark, d)
    return o.select("o_orderkey", (F.floor(G.model_error(W.pose_of(o), 100.0) * 1e3 + 0.5) / 1e3).alias("err"))


@query(f"""WITH {W.POINTS}, q AS (SELECT pt_id, trunc(400 * x / z + 320) AS u, trunc(400 * y / z + 240) AS v FROM p WHERE z > 0.001) SELECT pt_id, CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM q WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480""")
def pinhole_project(spark, d):
    p = W.points(spark, d).filter("z > 0.001")
    u, v = G.pinhole(F.col("x"), F.col("y"), F.col("z"), 400, 400, 320, 240)
    return p.select("pt_id", u.alias("u"), v.alias("v")).filter("u >= 0 AND u < 640 AND v >= 0 AND v < 480")


@query(f"""WITH q AS (SELECT o_orderkey, o_totalprice % 60e0 AS lat, o_custkey % 180 AS lon FROM orders)
SELECT o_orderkey, floor(lon * {math.pi!r} * 6378137.0e0 / 180 + 0.5e0) AS mx, floor(6378137.0e0 * ln(tan((90 + lat) * {math.pi!r} / 360)) + 0.5e0) AS my FROM q""")
def mercator(spark, d):
    o = W.table(spark, d, "orders")
    x, y = G.mercator(F.pmod("o_totalprice", F.lit(60.0)), (F.col("o_custkey") % 180).cast("double"), F.lit(1.0))
    return o.select("o_orderkey", F.floor(x + 0.5).cast("double").alias("mx"), F.floor(y + 0.5).cast("double").alias("my"))


@query(f"""WITH {W.POINTS} SELECT pt_id, {s6('sqrt(x*x + y*y + z*z)')} AS r, {s6('acos(z / nullif(sqrt(x*x + y*y + z*z), 0))')} AS polar, {s6('0.5 * (1 - atan2(y, x) / pi())')} AS rel FROM p""")
def spherical(spark, d):
    p = W.points(spark, d)
    r, polar, _ = G.spherical(F.col("x"), F.col("y"), F.col("z"))
    return p.select("pt_id", r6(r).alias("r"), r6(polar).alias("polar"), r6(G.yaw_time(F.col("x"), F.col("y"))).alias("rel"))


@query(f"""WITH {W.POSES} SELECT o_orderkey, {s6('tx / 10')} AS v0, {s6('ty / 10')} AS v1, {s6('(yaw - 3) / 3')} AS v3 FROM o""")
def twist_round_trip(spark, d):
    o = W.poses(spark, d)
    v = [F.col("tx") / 10, F.col("ty") / 10, F.lit(0.5), (F.col("yaw") - 3) / 3, F.lit(0.25), F.lit(-0.5)]
    # The pose as columns of their own, so that the expressions of log() refer to them.
    back = G.log(G.pose("e_"))
    o = o.select("o_orderkey", *[c.alias(f"e_{n}") for n, c in G.exp(v).items()])
    return o.select("o_orderkey", *[r6(back[i]).alias(f"v{i}") for i in (0, 1, 3)])


@query(f"""WITH {W.POSES}, q AS (SELECT o_orderkey, tx / 10 AS a, ty / 10 AS b, yaw - 3 AS w FROM o)
SELECT o_orderkey, {s6('cos(w)')} AS r00, {s6('sin(w)')} AS r10, {s6('(sin(w) * a - (1 - cos(w)) * b) / w')} AS tx, {s6('((1 - cos(w)) * a + sin(w) * b) / w')} AS ty FROM q""")
def twist_exp(spark, d):
    """SE3: the pose of a twist about z, against its closed form."""
    o = W.poses(spark, d)
    zero = F.lit(0.0)
    made = G.exp([F.col("tx") / 10, F.col("ty") / 10, zero, zero, zero, F.col("yaw") - 3])
    return o.select("o_orderkey", *[r6(made[c]).alias(c) for c in ("r00", "r10", "tx", "ty")])


@query(f"""WITH {W.TRAJECTORIES}, f AS (SELECT *, tx - first_value(tx) OVER w AS dx, ty - first_value(ty) OVER w AS dy FROM tr WINDOW w AS (PARTITION BY seq_id ORDER BY idx))
SELECT seq_id, idx, {s6('cos(0.3e0) * dx + sin(0.3e0) * dy')} AS tx, {s6('cos(0.3e0) * dy - sin(0.3e0) * dx')} AS ty, {s6('sin(0.1e0 * idx)')} AS r10 FROM f""")
def to_local_frame(spark, d):
    """SE18: trajectories that start with a turn of 0.3 and go on turning."""
    t = W.turning(W.trajectories(spark, d), 0.1, 0.3)
    w = Window.partitionBy("seq_id").orderBy("idx")
    t = t.withColumns({f"f_{c}": F.first(c).over(w) for c in G.NAMES})
    local = G.relative(G.pose("f_"), G.pose())
    return t.select("seq_id", "idx", *[r6(local[c]).alias(c) for c in ("tx", "ty", "r10")])


@query(f"""WITH {W.TRAJECTORIES}, f AS (SELECT *, lag(tx, 1) OVER w AS x1, lag(ty, 1) OVER w AS y1, lag(tx, 2) OVER w AS x2, lag(ty, 2) OVER w AS y2 FROM tr WINDOW w AS (PARTITION BY seq_id ORDER BY idx)) SELECT seq_id, idx, {s6('x1 + (x1 - x2)')} AS gx, {s6('y1 + (y1 - y2)')} AS gy FROM f WHERE idx >= 2""")
def constant_velocity(spark, d):
    """WN1."""
    t = W.trajectories(spark, d)
    w = Window.partitionBy("seq_id").orderBy("idx")
    t = t.withColumns({f"{c}{k}": F.lag(c, k).over(w) for c in ("tx", "ty", "tz") for k in (1, 2)}).filter("idx >= 2")
    last, before = (G.identity() | {c: F.col(f"{c}{k}") for c in ("tx", "ty", "tz")} for k in (1, 2))
    guess = G.compose(last, G.relative(before, last))
    return t.select("seq_id", "idx", r6(guess["tx"]).alias("gx"), r6(guess["ty"]).alias("gy"))


# Voxels.

_V = ", ".join(f"CAST(trunc({a} / {{0}}) AS INT) AS v{a}" for a in "xyz")
_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, {k} ORDER BY pt_id) AS n FROM {t}) WHERE n = 1"


@query(f"WITH {W.POINTS}, k AS (SELECT *, {_V.format('8e0')} FROM p) SELECT frame_id, pt_id, {_XYZ} FROM ({_FIRST.format(k='vx, vy, vz', t='k')})")
def voxel_first(spark, d):
    return _xyz(P.voxel_first(W.points(spark, d), 8.0, "frame_id"), "frame_id", "pt_id")


@query(f"WITH {W.POINTS}, k AS (SELECT *, {_V.format('2e0')} FROM p), f AS (SELECT pt_id, frame_id, x, y, z FROM ({_FIRST.format(k='vx, vy, vz', t='k')})), g AS (SELECT *, {_V.format('6e0')} FROM f) SELECT frame_id, pt_id, {_XYZ} FROM ({_FIRST.format(k='vx, vy, vz', t='g')})")
def voxel_double(spark, d):
    return _xyz(P.voxel_double(W.points(spark, d), 4.0, "frame_id"), "frame_id", "pt_id")


@query(f"WITH {W.POINTS}, k AS (SELECT *, {_V.format('8e0')} FROM p) SELECT frame_id, pt_id, vx, vy, vz FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, vx, vy, vz ORDER BY pt_id) AS n FROM k) WHERE n <= 5")
def voxel_cap_k(spark, d):
    return P.voxel_cap(W.points(spark, d), 8.0, 5, "frame_id").select("frame_id", "pt_id", "vx", "vy", "vz")


@query(f"WITH {W.POINTS}, k AS (SELECT *, {_V.format('8e0')} FROM p), f AS (SELECT *, first_value(x*x + y*y + z*z) OVER (PARTITION BY frame_id, vx, vy, vz ORDER BY pt_id) AS d2 FROM k) SELECT frame_id, pt_id FROM f WHERE d2 <= 900")
def voxel_evict(spark, d):
    return P.voxel_evict(W.points(spark, d), 8.0, 30.0, (0.0, 0.0, 0.0), "frame_id").select("frame_id", "pt_id")


@query(f"WITH {W.POINTS}, k AS (SELECT *, CAST(floor(x / 8e0) AS INT) AS vx, CAST(floor(y / 8e0) AS INT) AS vy, CAST(floor(z / 8e0) AS INT) AS vz FROM p) SELECT frame_id, pt_id FROM ({_FIRST.format(k='vx, vy, vz', t='k')})")
def voxel_floor(spark, d):
    return P.voxel_first(W.points(spark, d), 8.0, "frame_id", floor=True).select("frame_id", "pt_id")


@query(f"""WITH {W.POINTS}, m AS (SELECT frame_id, min(x) - 4 AS ox, min(y) - 4 AS oy, min(z) - 4 AS oz FROM p GROUP BY frame_id),
k AS (SELECT p.*, CAST(floor((x - ox) / 8) AS INT) AS vx, CAST(floor((y - oy) / 8) AS INT) AS vy, CAST(floor((z - oz) / 8) AS INT) AS vz FROM p JOIN m USING (frame_id))
SELECT frame_id, vx, vy, vz, floor(avg(x) * 1e6 + 0.3137e0) / 1e6 AS x, floor(avg(y) * 1e6 + 0.3137e0) / 1e6 AS y, floor(avg(z) * 1e6 + 0.3137e0) / 1e6 AS z, count(*) AS n FROM k GROUP BY frame_id, vx, vy, vz""")
def voxel_centroid(spark, d):
    # Means of few values lie half way between decimals, where engines differ; the shift keeps off there.
    found = P.voxel_centroid(W.points(spark, d), 8.0, "frame_id")
    return found.select("frame_id", "vx", "vy", "vz", "n", *[(F.floor(F.col(c) * 1e6 + 0.3137) / 1e6).alias(c) for c in "xyz"])


@query(f"""WITH {W.POINTS}, k AS (SELECT pt_id, frame_id // 2 AS pair, x, y, z, {_V.format('8e0')} FROM p), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, vx, vy, vz ORDER BY pt_id) AS n FROM k) WHERE n <= 20),
f AS (SELECT *, first_value(x*x + y*y + z*z) OVER (PARTITION BY pair, vx, vy, vz ORDER BY pt_id) AS d2 FROM c) SELECT pair, pt_id FROM f WHERE d2 <= 1600""")
def map_union(spark, d):
    a, b = W.pairs_of_frames(spark, d)
    return P.map_update(a.drop("frame_id"), b.drop("frame_id"), 8.0, 20, 40.0, (0.0, 0.0, 0.0), "pair").select("pair", "pt_id")


# Neighbours.

_KEYED = "sk AS (SELECT s.*, CAST(trunc(x) AS INT) AS vx, CAST(trunc(y) AS INT) AS vy, CAST(trunc(z) AS INT) AS vz FROM s), tk AS (SELECT t.*, CAST(trunc(x) AS INT) AS vx, CAST(trunc(y) AS INT) AS vy, CAST(trunc(z) AS INT) AS vz FROM t), o3 AS (SELECT unnest([-1, 0, 1]) AS o), c AS (SELECT sk.*, sk.vx + a.o AS cx, sk.vy + b.o AS cy, sk.vz + e.o AS cz FROM sk, o3 a, o3 b, o3 e)"
_D2 = "(c.x - tk.x) * (c.x - tk.x) + (c.y - tk.y) * (c.y - tk.y) + (c.z - tk.z) * (c.z - tk.z)"
_CELL_JOIN = "c JOIN tk ON c.pair = tk.pair AND c.cx = tk.vx AND c.cy = tk.vy AND c.cz = tk.vz"


@query(f"""WITH {W.PAIRS}, {_KEYED}, j AS (SELECT c.pair, c.pt_id AS src_id, tk.pt_id AS tgt_id, {_D2} AS d2 FROM {_CELL_JOIN}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY d2, tgt_id) AS n FROM j) WHERE n = 1) SELECT pair, src_id, tgt_id, {s6('sqrt(d2)')} AS d FROM b WHERE sqrt(d2) < 1.5""")
def nn_cell_join(spark, d):
    a, b = W.pairs_of_frames(spark, d)
    return N.nearest_in_cells(a, b, 1.0, 1.5, "pair").select("pair", "src_id", "tgt_id", r6(F.col("d")).alias("d"))


@query(f"""WITH {W.PAIRS}, {_KEYED}, j AS (SELECT c.pair, c.pt_id AS src_id, tk.pt_id AS tgt_id, {_D2} AS d2, (c.x * tk.x + c.z * tk.z) / (sqrt(c.x * c.x + c.z * c.z) * sqrt(tk.x * tk.x + tk.z * tk.z) + 1e-5) AS cosine, c.x + c.z AS su, tk.x + tk.z AS tu FROM {_CELL_JOIN}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY d2 * CASE WHEN su <> 0 AND tu <> 0 THEN greatest(least(0.5 * (1 - cosine), 1), 0.01) ELSE 1 END, tgt_id) AS n FROM j) WHERE n = 1) SELECT pair, src_id, tgt_id, {s6('sqrt(d2)')} AS d FROM b WHERE sqrt(d2) < 1.5""")
def nn_hybrid(spark, d):
    a, b = (x.withColumn("desc", F.array("x", "z")) for x in W.pairs_of_frames(spark, d))
    return N.nearest_hybrid(a, b, 1.0, 1.5, "pair").select("pair", "src_id", "tgt_id", r6(F.col("d")).alias("d"))


_BEST = "n AS (SELECT src_id, tgt_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY sim DESC, tgt_id) AS k FROM ab) WHERE k = 1)"
_BACK = "m AS (SELECT src_id, tgt_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY tgt_id ORDER BY sim DESC, src_id) AS k FROM ab) WHERE k = 1)"


@query(f"WITH {W.DESCRIPTORS}, {_BEST} SELECT src_id, tgt_id, {s6('sim')} AS sim FROM n WHERE sim >= 0.3")
def cosine_nn(spark, d):
    return N.cosine_nearest(*W.descriptors(spark, d), 0.3).withColumn("sim", r6(F.col("sim")))


@query(f"WITH {W.DESCRIPTORS}, {_BEST}, x AS (SELECT src_id, tgt_id, sqrt(2 - 2 * sim + 1e-6) AS d FROM n) SELECT src_id, tgt_id, {s6('d')} AS d FROM x ORDER BY x.d, src_id LIMIT (SELECT least(100, count(*) - 1) FROM n)")
def top_n_matches(spark, d):
    found = N.similarity_top(*W.descriptors(spark, d)).select(F.col("id").alias("src_id"), F.col("other").alias("tgt_id"), N.distance_of(F.col("sim")).alias("d"))
    return N.smallest(found, 100).withColumn("d", r6(F.col("d")))


@query(f"WITH {W.DESCRIPTORS}, {_BEST}, {_BACK} SELECT n.src_id, n.tgt_id, {s6('n.sim')} AS sim FROM n JOIN m ON n.src_id = m.src_id AND n.tgt_id = m.tgt_id")
def mutual_nn(spark, d):
    return N.mutual_nearest(*W.descriptors(spark, d)).withColumn("sim", r6(F.col("sim")))


@query(f"WITH {W.DESCRIPTORS}, {_BEST} SELECT src_id, tgt_id, {s6('sqrt(2 - 2 * sim + 1e-6)')} AS d FROM n")
def pointdsc_match(spark, d):
    return N.similarity_top(*W.descriptors(spark, d)).select(F.col("id").alias("src_id"), F.col("other").alias("tgt_id"), r6(N.distance_of(F.col("sim"))).alias("d"))


@query(f"""WITH {W.DESCRIPTORS}, x AS (SELECT p.id AS id, q.id AS other, list_inner_product(p.v, q.v) AS sim FROM e p, e q) SELECT id, other, CAST(k - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS k FROM x) WHERE k BETWEEN 2 AND 6""")
def feature_knn(spark, d):
    a, b = W.descriptors(spark, d)
    e = a.unionByName(b)
    return N.similarity_top(e, e, 6).filter("rank > 1").select("id", "other", (F.col("rank") - 1).alias("rank"))


@query(f"WITH {W.DESCRIPTORS}, {_BEST}, {_BACK} SELECT 0 AS side, {s6('avg(2 - 2 * sim)')} AS d2 FROM n UNION ALL SELECT 1, {s6('avg(2 - 2 * sim)')} FROM m")
def chamfer(spark, d):
    return N.similarity_top(*W.descriptors(spark, d), 1, both=True).groupBy("side").agg(r6(F.avg(2 - 2 * F.col("sim"))).alias("d2"))


@query(f"""WITH {W.DESCRIPTORS}, k AS (SELECT *, 1 / (sqrt(greatest(2 - 2 * sim, 0)) + 1e-8) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY sim DESC, tgt_id) AS k FROM ab) WHERE k <= 3) SELECT src_id, {s6('sum(w * label) / sum(w)')} AS value FROM k GROUP BY src_id""")
def three_nn_interpolate(spark, d):
    a, b = W.descriptors(spark, d)
    near = N.similarity_top(a, b, 3).join(b.select(F.col("id").alias("other"), "label"), "other")
    w = 1 / (F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))) + 1e-8)
    return near.groupBy(F.col("id").alias("src_id")).agg(r6(F.sum(w * F.col("label")) / F.sum(w)).alias("value"))


_IN = "r AS (SELECT a.pt_id AS src_id, b.pt_id AS tgt_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM pc a JOIN pf b ON a.frame_id = b.frame_id AND a.cx = b.vx AND a.cy = b.vy AND a.cz = b.vz), h AS (SELECT * FROM r WHERE d2 < 1)"
_CELLS = f"{W.POINTS}, pf AS (SELECT *, CAST(floor(x) AS INT) AS vx, CAST(floor(y) AS INT) AS vy, CAST(floor(z) AS INT) AS vz FROM p), o3 AS (SELECT unnest([-1, 0, 1]) AS o), pc AS (SELECT pf.*, vx + i.o AS cx, vy + j.o AS cy, vz + k.o AS cz FROM pf, o3 i, o3 j, o3 k)"


@query(f"WITH {_CELLS}, {_IN}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY d2, tgt_id) AS n FROM h) WHERE n <= 10) SELECT p.pt_id AS src_id, CAST(count(*) FILTER (d2 > 0) AS BIGINT) AS n FROM p LEFT JOIN k ON p.pt_id = k.src_id GROUP BY p.pt_id")
def radius_count(spark, d):
    p = W.points(spark, d)
    return N.radius_count(p, p, 1.0, 1.0, 10, "frame_id")


@query(f"WITH {_CELLS}, {_IN}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY d2, tgt_id) AS n FROM h) WHERE n <= 10) SELECT DISTINCT tgt_id FROM k WHERE d2 > 0")
def knn_radius_distinct(spark, d):
    p = W.points(spark, d)
    return N.near_distinct(p, p, 1.0, 1.0, 10, "frame_id")


@query(f"WITH {_CELLS}, {_IN}, g AS (SELECT src_id, list(tgt_id ORDER BY tgt_id)[1:3] AS l FROM h GROUP BY src_id), z AS (SELECT src_id, unnest([0, 1, 2]) AS slot, l FROM g) SELECT src_id, CAST(slot AS INT) AS slot, coalesce(l[slot + 1], l[1]) AS tgt_id FROM z")
def ball_query(spark, d):
    p = W.points(spark, d)
    return N.ball_query(p, p, 1.0, 1.0, 3, "frame_id")


@query(f"WITH {_CELLS}, {_IN}, b AS (SELECT DISTINCT h.src_id FROM h JOIN p t ON h.tgt_id = t.pt_id JOIN p s ON h.src_id = s.pt_id WHERE t.x > s.x) SELECT pt_id FROM p WHERE pt_id NOT IN (SELECT src_id FROM b)")
def nms(spark, d):
    return N.maxima(W.points(spark, d), "x", 1.0, 1.0, "frame_id").select("pt_id")


_PIXELS = "px AS (SELECT CAST(o_custkey % 2 AS INT) AS camera, CAST(o_orderkey % 64 AS INT) AS u, CAST(o_custkey % 48 AS INT) AS v, max(o_totalprice) AS feature FROM orders GROUP BY ALL)"


@query(f"""WITH {W.POINTS}, {_PIXELS}, c AS (SELECT pt_id, 0 AS camera, trunc(40 * x / z + 32) AS u, trunc(40 * y / z + 24) AS v FROM p WHERE z > 0.001 UNION ALL SELECT pt_id, 1, trunc(40 * y / z + 32), trunc(40 * x / z + 24) FROM p WHERE z > 0.001),
s AS (SELECT pt_id, c.camera, feature, row_number() OVER (PARTITION BY pt_id ORDER BY c.camera) AS n FROM c JOIN px ON c.camera = px.camera AND c.u = px.u AND c.v = px.v)
SELECT p.pt_id, CAST(coalesce(camera, -1) AS INT) AS camera, coalesce(feature, 0) AS feature FROM p LEFT JOIN s ON p.pt_id = s.pt_id AND n = 1""")
def camera_dedupe(spark, d):
    """JN19: two cameras with swapped axes; the first one whose image has the pixel gives the feature, none gives zero."""
    p = W.points(spark, d)
    seen = p.filter("z > 0.001")
    of = None
    for camera, (a, b) in enumerate((("x", "y"), ("y", "x"))):
        u, v = G.pinhole(F.col(a), F.col(b), F.col("z"), 40, 40, 32, 24)
        part = seen.select("pt_id", F.lit(camera).alias("camera"), u.alias("u"), v.alias("v")).filter(G.in_image(F.col("u"), F.col("v"), 64, 48))
        of = part if of is None else of.unionByName(part)
    o = W.table(spark, d, "orders")
    pixels = o.groupBy((F.col("o_custkey") % 2).cast("int").alias("camera"), (F.col("o_orderkey") % 64).cast("int").alias("u"), (F.col("o_custkey") % 48).cast("int").alias("v")).agg(F.max("o_totalprice").alias("feature"))
    return P.gathered(of, pixels, p).select("pt_id", F.coalesce("camera", F.lit(-1)).alias("camera"), F.coalesce("feature", F.lit(0.0)).alias("feature"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def complement_set(spark, d):
    orders = W.table(spark, d, "orders").filter("o_orderkey % 7 = 0")
    return W.table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# Time.

_AS = f"{W.TRAJECTORIES}, q AS (SELECT seq_id, t, event_id AS q FROM tr WHERE event_type = (SELECT min(event_type) FROM tr)), sm AS (SELECT seq_id, t, avg(value) AS value FROM tr WHERE event_type <> (SELECT min(event_type) FROM tr) GROUP BY seq_id, t)"


def _queries(spark, d):
    t = W.trajectories(spark, d)
    first = t.agg(F.min("event_type").alias("first"))
    t = t.join(F.broadcast(first))
    q = t.filter("event_type = first").select("seq_id", "t", F.col("event_id").alias("q"))
    return q, t.filter("event_type != first").groupBy("seq_id", "t").agg(F.avg("value").alias("value"))


@query(f"WITH {_AS} SELECT seq_id, q, t, nearest FROM (SELECT q.seq_id, q.q, q.t, sm.t AS nearest, row_number() OVER (PARTITION BY q.q ORDER BY abs(sm.t - q.t), sm.t) AS n FROM q LEFT JOIN sm ON q.seq_id = sm.seq_id) WHERE n = 1")
def nearest_asof(spark, d):
    return T.nearest(*_queries(spark, d), "seq_id")


@query(f"""WITH {_AS}, lo AS (SELECT q.seq_id, q.q, q.t, max(sm.t) FILTER (sm.t <= q.t) AS lo, min(sm.t) FILTER (sm.t > q.t) AS hi FROM q JOIN sm ON q.seq_id = sm.seq_id GROUP BY ALL)
SELECT lo.seq_id, q, lo.t, {s6('a.value + (lo.t - lo) / (hi - lo) * (b.value - a.value)')} AS value FROM lo JOIN sm a ON a.seq_id = lo.seq_id AND a.t = lo.lo JOIN sm b ON b.seq_id = lo.seq_id AND b.t = lo.hi""")
def bracket_interp(spark, d):
    q, s = _queries(spark, d)
    return T.interpolate(q, s, "seq_id", "value").withColumn("value", r6(F.col("value")))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders INTERSECT SELECT strftime(l_shipdate, '%Y-%m-%d') FROM lineitem")
def timestamp_intersect(spark, d):
    return W.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).intersect(W.table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd")))


@query(f"WITH {W.TRAJECTORIES} SELECT seq_id, idx, t FROM tr WHERE idx % 2 = 0")
def stride_sample(spark, d):
    return T.stride(W.trajectories(spark, d), "seq_id", "idx", 2).select("seq_id", "idx", "t")


@query(f"WITH {W.TRAJECTORIES} SELECT seq_id, idx, {s6('(t - min(t) OVER (PARTITION BY seq_id)) / 1e6')} AS rel_s FROM tr")
def relative_time(spark, d):
    return T.relative_time(W.trajectories(spark, d), "seq_id", "t").select("seq_id", "idx", r6(F.col("rel_s")).alias("rel_s"))


@query(f"WITH {W.TRAJECTORIES}, m AS (SELECT *, min(t) OVER (PARTITION BY seq_id) AS a, max(t) OVER (PARTITION BY seq_id) AS b FROM tr) SELECT seq_id, idx, {s6('CASE WHEN b > a THEN (t - a) / (b - a) ELSE 0 END')} AS rel FROM m")
def frame_time_norm(spark, d):
    return T.frame_time(W.trajectories(spark, d), "seq_id", "t").select("seq_id", "idx", r6(F.col("rel")).alias("rel"))


@query(f"WITH {_AS}, m AS (SELECT seq_id, min(t) AS a, max(t) AS b FROM sm GROUP BY seq_id) SELECT q.seq_id, q, t FROM q JOIN m ON q.seq_id = m.seq_id WHERE t > a AND t < b")
def valid_range(spark, d):
    q, s = _queries(spark, d)
    return T.inside(q, s, "seq_id", "t", strict=True).select("seq_id", "q", "t")


# Statistics and metrics.


@query(f"""WITH er AS (SELECT l_returnflag AS method, l_extendedprice AS d, l_orderkey, l_linenumber FROM lineitem), m AS (SELECT method, median(d) AS md FROM er GROUP BY method), k AS (SELECT method, md, 1.4826 * median(abs(d - md)) AS mad FROM er JOIN m USING (method) GROUP BY method, md)
SELECT method, count(*) AS n, {s6('min(d)')} AS low, {s6('max(d)')} AS high FROM er JOIN k USING (method) WHERE abs(d - md) < 1.5 * mad GROUP BY method""")
def mad_inliers(spark, d):
    rows = W.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").alias("d"))
    return M.mad_inliers(rows, "d", "method").groupBy("method").agg(F.count("*").alias("n"), r6(F.min("d")).alias("low"), r6(F.max("d")).alias("high"))


@query(f"WITH {W.ERRORS} SELECT method, scene, {s6('avg(rte)')} AS mean_rte, {s6('stddev_pop(rte)')} AS std_rte, {s6('avg(rre)')} AS mean_rre, {s6('stddev_pop(rre)')} AS std_rre, count(*) AS n FROM er GROUP BY method, scene")
def error_summary(spark, d):
    out = M.error_summary(W.errors(spark, d), "method", "scene")
    return out.select("method", "scene", "n", *[r6(F.col(c)).alias(c) for c in out.columns if c[:4] in ("mean", "std_")])


_REACH = ", ".join(s6(f"100 * avg(CASE WHEN rte < {t} AND rre < {r} THEN 1.0 ELSE 0.0 END)") + f" AS recall_{i}" for i, (t, r) in enumerate(M.THRESHOLDS))


@query(f"WITH {W.ERRORS} SELECT method, {_REACH} FROM er GROUP BY method")
def recall_at_thresholds(spark, d):
    out = M.recall(W.errors(spark, d), "method")
    return out.select("method", *[r6(F.col(c)).alias(c) for c in out.columns[1:]])


@query(f"WITH {W.ERRORS} SELECT method, {s6('avg(rte) FILTER (rte < 0.3 AND rre < 15)')} AS rte, {s6('avg(rre) FILTER (rte < 0.3 AND rre < 15)')} AS rre, CAST(count(*) FILTER (rte < 0.3 AND rre < 15) AS BIGINT) AS n FROM er GROUP BY method")
def success_only_stats(spark, d):
    return M.success_only(W.errors(spark, d), "method").select("method", r6(F.col("rte")).alias("rte"), r6(F.col("rre")).alias("rre"), "n")


@query(f"""WITH {W.TRAJECTORIES}, m AS (SELECT seq_id, idx, CASE WHEN value > 50 THEN value END AS e FROM tr), w AS (SELECT seq_id, idx, count(e) OVER o AS n, sum(e * e) OVER o AS s FROM m WINDOW o AS (PARTITION BY seq_id ORDER BY idx))
SELECT seq_id, idx, {s6('CASE WHEN n > 0 THEN sqrt(s / n) ELSE 2 END')} AS sigma FROM w""")
def running_sigma(spark, d):
    return M.running_sigma(W.trajectories(spark, d), "seq_id", "idx", "value", 50, 2.0).select("seq_id", "idx", r6(F.col("sigma")).alias("sigma"))


_WAY = f"{W.TRAJECTORIES}, st AS (SELECT seq_id, idx, tx, ty, coalesce(sqrt((tx - lag(tx) OVER w) * (tx - lag(tx) OVER w) + (ty - lag(ty) OVER w) * (ty - lag(ty) OVER w)), 0) AS s FROM tr WINDOW w AS (PARTITION BY seq_id ORDER BY idx)), wy AS (SELECT seq_id, idx, tx, ty, sum(s) OVER (PARTITION BY seq_id ORDER BY idx) AS dist FROM st)"


@query(f"WITH {_WAY} SELECT seq_id, idx, {s6('dist')} AS dist FROM wy")
def traj_distance(spark, d):
    return M.travelled(W.trajectories(spark, d), "seq_id", "idx").select("seq_id", "idx", r6(F.col("dist")).alias("dist"))


_SEGMENTS = f"{_WAY}, sg AS (SELECT a.seq_id, a.idx AS first, CAST(n.l AS INT) AS length, min(b.idx) AS last FROM wy a, (SELECT unnest([100, 200, 300, 400, 500, 600, 700, 800]) AS l) n, wy b WHERE a.idx % 10 = 0 AND b.seq_id = a.seq_id AND b.idx >= a.idx AND b.dist > a.dist + n.l GROUP BY ALL)"


@query(f"WITH {_SEGMENTS} SELECT * FROM sg")
def segment_last_frame(spark, d):
    return M.segments(W.trajectories(spark, d), "seq_id", "idx")


@query(f"""WITH {_SEGMENTS}, g AS (SELECT sg.seq_id, length, b.tx - a.tx AS dx, b.ty - a.ty AS dy, 0.01e0 * a.idx AS y, 0.012e0 * a.idx + 0.05e0 AS z, 0.002e0 * (b.idx - a.idx) AS r
FROM sg JOIN wy a ON a.seq_id = sg.seq_id AND a.idx = first JOIN wy b ON b.seq_id = sg.seq_id AND b.idx = last),
e AS (SELECT seq_id, length, r, cos(y) * dx + sin(y) * dy - cos(z) * dx * 1.02e0 - sin(z) * dy * 0.99e0 AS ex, cos(y) * dy - sin(y) * dx - cos(z) * dy * 0.99e0 + sin(z) * dx * 1.02e0 AS ey FROM g)
SELECT seq_id, {s6('100 * avg(sqrt(ex * ex + ey * ey) / length)')} AS terr, {s6('avg(acos(cos(r)) / length) / 3.14e0 * 180')} AS rerr, count(*) AS n FROM e GROUP BY seq_id""")
def segment_errors(spark, d):
    """AG9: an estimate that stretches and turns too fast against the truth."""
    t = W.trajectories(spark, d)
    estimate = W.turning(t.withColumns({"tx": F.col("tx") * 1.02, "ty": F.col("ty") * 0.99}), 0.012, 0.05)
    out = M.segment_errors(W.turning(t, 0.01, 0.0), estimate, "seq_id", "idx")
    return out.select("seq_id", r6(F.col("terr")).alias("terr"), r6(F.col("rerr")).alias("rerr"), "n")


@query(f"""WITH {W.TRAJECTORIES}, q AS (SELECT seq_id, tx, ty, 0.01e0 * idx AS y, cos(0.3e0) * tx * 1.02e0 - sin(0.3e0) * ty + 5 AS ex, sin(0.3e0) * tx * 1.02e0 + cos(0.3e0) * ty - 2 AS ey, 0.012e0 * idx + 0.3e0 AS z FROM tr),
m AS (SELECT seq_id, avg(ex) AS cx, avg(ey) AS cy, avg(tx) AS mx, avg(ty) AS my, atan2(covar_pop(ex, ty) - covar_pop(ey, tx), covar_pop(ex, tx) + covar_pop(ey, ty)) AS a FROM q GROUP BY seq_id),
b AS (SELECT seq_id, tx, ty, y - z - a AS r, cos(a) * (ex - cx) - sin(a) * (ey - cy) + mx AS px, sin(a) * (ex - cx) + cos(a) * (ey - cy) + my AS py FROM q JOIN m USING (seq_id))
SELECT seq_id, {s6('sqrt(avg(acos(cos(r)) * acos(cos(r))))')} AS rotation, {s6('sqrt(avg((tx - cos(r) * px + sin(r) * py) * (tx - cos(r) * px + sin(r) * py) + (ty - sin(r) * px - cos(r) * py) * (ty - sin(r) * px - cos(r) * py)))')} AS translation, count(*) AS n FROM b GROUP BY seq_id""")
def trajectory_errors(spark, d):
    """AG10: an estimate that is turned, moved and stretched against the truth."""
    t = W.trajectories(spark, d)
    c, s = math.cos(0.3), math.sin(0.3)
    moved = t.withColumns({"tx": c * F.col("tx") * 1.02 - s * F.col("ty") + 5, "ty": s * F.col("tx") * 1.02 + c * F.col("ty") - 2})
    out = M.absolute_errors(W.turning(t, 0.01, 0.0), W.turning(moved, 0.012, 0.3), "seq_id", "idx")
    return out.select("seq_id", r6(F.col("rotation")).alias("rotation"), r6(F.col("translation")).alias("translation"), "n")


# Solvers.


def _pairs(spark, d):
    p = W.points(spark, d)
    pose = G.from_euler(F.lit(0.0), F.lit(0.0), F.col("frame_id") * 0.01) | {"tx": F.col("frame_id") * 0.02}
    x, y, z = G.apply(pose, F.col("x"), F.col("y"), F.col("z"))
    return p.select("frame_id", "pt_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), x.alias("tx"), y.alias("ty"), z.alias("tz"))


_PAIRED = f"{W.POINTS}, pr AS (SELECT frame_id, pt_id, x AS sx, y AS sy, z AS sz, cos(frame_id * 0.01) * x - sin(frame_id * 0.01) * y + frame_id * 0.02 AS tx, sin(frame_id * 0.01) * x + cos(frame_id * 0.01) * y AS ty, z AS tz FROM p)"


_J = [["1", "0", "0", "0", "sz", "(-sy)"], ["0", "1", "0", "(-sz)", "0", "sx"], ["0", "0", "1", "sy", "(-sx)", "0"]]
_CENT = "floor(({}) * 1e2 + 0.5e0) / 1e2"
_H = ", ".join(_CENT.format("sum(w * (" + " + ".join(f"{_J[i][a]} * {_J[i][b]}" for i in range(3)) + "))") + f" AS h{a}{b}" for a in range(6) for b in range(a, 6))
_G = ", ".join(_CENT.format("sum(w * (" + " + ".join(f"{_J[i][a]} * (s{'xyz'[i]} - t{'xyz'[i]})" for i in range(3)) + "))") + f" AS g{a}" for a in range(6))


@query(f"""WITH {_PAIRED}, w AS (SELECT *, 0.25e0 / pow(0.5e0 + (sx - tx) * (sx - tx) + (sy - ty) * (sy - ty) + (sz - tz) * (sz - tz), 2) AS w FROM pr) SELECT frame_id, {_H}, {_G} FROM w GROUP BY frame_id""")
def normal_equations(spark, d):
    """AG1: all 27 sums."""
    row = S.normal_equations(_pairs(spark, d), 0.5, "frame_id")
    return row.select("frame_id", *[(F.floor(F.col(c) * 1e2 + 0.5) / 1e2).alias(c) for c in row.columns[1:]])


_MILLI = "floor(({}) * 1e3 + 0.5e0) / 1e3"
_TENTH = "floor(({}) * 1e4 + 0.5e0) / 1e4"


def _rounded(c, to: float):
    return F.floor(F.col(c) * to + 0.5) / to


@query(f"""WITH {_PAIRED}, w AS (SELECT *, 1e0 / (1 + pt_id % 7) AS w FROM pr), m AS (SELECT frame_id, sum(w * sx) / (sum(w) + 1e-6) AS csx, sum(w * sy) / (sum(w) + 1e-6) AS csy, sum(w * ty) / (sum(w) + 1e-6) AS cty FROM w GROUP BY frame_id)
SELECT frame_id, {s6('any_value(csx)')} AS csx, {s6('any_value(cty)')} AS cty, {_MILLI.format('sum(w * (sx - csx) * (ty - cty))')} AS hxy, {_MILLI.format('sum(w * (sy - csy) * (ty - cty))')} AS hyy FROM w JOIN m USING (frame_id) GROUP BY frame_id""")
def weighted_centroid_cov(spark, d):
    """AG3: weights between 1/7 and 1."""
    pairs = _pairs(spark, d).withColumn("w", 1 / (1 + F.col("pt_id") % 7))
    out = S.weighted_sums(pairs, "w", "frame_id")
    return out.select("frame_id", r6(F.col("csx")).alias("csx"), r6(F.col("cty")).alias("cty"), _rounded("hxy", 1e3).alias("hxy"), _rounded("hyy", 1e3).alias("hyy"))


@query(f"""SELECT CAST(f AS BIGINT) AS frame_id, {s6('cos(f * 0.01)')} AS r00, {s6('f * 0.02')} AS tx FROM (SELECT DISTINCT l_orderkey % 50 AS f FROM lineitem)""")
def kabsch_svd(spark, d):
    """AG3: the known pose of each frame comes back."""
    return S.solve_groups(_pairs(spark, d), "frame_id").select("frame_id", r6(F.col("r00")).alias("r00"), r6(F.col("tx")).alias("tx"))


_KNOWN = f"SELECT CAST(f AS BIGINT) AS frame_id, {_TENTH.format('cos(f * 0.01)')} AS r00, {_TENTH.format('f * 0.02')} AS tx FROM (SELECT DISTINCT l_orderkey % 50 AS f FROM lineitem)"


def _with_outliers(spark, d, share: int, off: float):
    """One pair in ten, `share` times, ends somewhere else."""
    return _pairs(spark, d).withColumn("tx", F.when(F.col("pt_id") % 10 < share, F.col("tx") + off + F.col("pt_id") % 97).otherwise(F.col("tx")))


@query(_KNOWN)
def ransac_register(spark, d):
    """IT4: three pairs in ten are outliers; the pose of the others comes back."""
    found = S.solve_groups(_with_outliers(spark, d, 3, 50.0), "frame_id", "ransac")
    return found.select("frame_id", _rounded("r00", 1e4).alias("r00"), _rounded("tx", 1e4).alias("tx"))


@query(_KNOWN)
def robust_register(spark, d):
    """IT2, first phase: one pair in ten is an outlier."""
    found = S.solve_groups(_with_outliers(spark, d, 1, 60.0), "frame_id", "robust")
    return found.select("frame_id", _rounded("r00", 1e4).alias("r00"), _rounded("tx", 1e4).alias("tx"))


@query(f"SELECT CAST(f AS BIGINT) AS frame_id, floor(0.05e0 * (f % 3) * 1e2 + 0.5e0) / 1e2 AS tx, floor(-0.05e0 * (f % 2) * 1e2 + 0.5e0) / 1e2 AS ty, {_MILLI.format('sin(0.001e0 * (f % 3))')} AS r10 FROM (SELECT DISTINCT l_orderkey % 50 AS f FROM lineitem)")
def icp_register(spark, d):
    """IT9: each frame against itself moved by a known pose."""
    p = W.points(spark, d)
    f = F.col("frame_id")
    pose = G.from_euler(F.lit(0.0), F.lit(0.0), f % 3 * 0.001) | {"tx": f % 3 * 0.05, "ty": f % 2 * -0.05}
    x, y, z = G.apply(pose, F.col("x"), F.col("y"), F.col("z"))
    found = S.pairwise(p, W.points(spark, d).select("frame_id", "pt_id", x.alias("x"), y.alias("y"), z.alias("z")), "frame_id", voxel=0.5, sigma=0.2)
    return found.select("frame_id", _rounded("tx", 1e2).alias("tx"), _rounded("ty", 1e2).alias("ty"), _rounded("r10", 1e3).alias("r10"))


def _fps_sql(n: int) -> str:
    point = "struct_pack(i := pt_id, x := x, y := y, z := z)"
    out = [W.POINTS, f"s0 AS (SELECT frame_id, arg_min({point}, pt_id) AS s FROM p GROUP BY frame_id)", "d0 AS (SELECT *, 1e10 AS m FROM p)"]
    for k in range(1, n):
        out.append(f"d{k} AS (SELECT q.frame_id, pt_id, x, y, z, least(m, (x - s.x) * (x - s.x) + (y - s.y) * (y - s.y) + (z - s.z) * (z - s.z)) AS m FROM d{k - 1} q JOIN s{k - 1} USING (frame_id))")
        out.append(f"s{k} AS (SELECT frame_id, arg_max({point}, (CASE WHEN x * x + y * y + z * z > 1e-3 THEN m ELSE -1 END, -pt_id)) AS s FROM d{k} GROUP BY frame_id)")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT frame_id, CAST({k} AS BIGINT) AS slot, s.i AS pt_id FROM s{k}" for k in range(n))


@query(_fps_sql(6))
def fps(spark, d):
    return S.farthest_points(W.points(spark, d), "frame_id", 6)


@query(f"""WITH {W.TRAJECTORIES}, m AS (SELECT seq_id, idx, tx - coalesce(lag(tx) OVER w, 0) + 0.1e0 * (idx % 3) AS ox FROM tr WINDOW w AS (PARTITION BY seq_id ORDER BY idx)),
e AS (SELECT seq_id, max(idx) AS n, arg_max(tx, idx) - arg_min(tx, idx) - sum(ox) FILTER (idx > 0) AS lx FROM m JOIN tr USING (seq_id, idx) GROUP BY seq_id),
c AS (SELECT seq_id, idx, ox + CASE WHEN idx > 0 THEN lx / (n + 1) ELSE 0 END AS ox FROM m JOIN e USING (seq_id))
SELECT seq_id, idx AS vertex, {_MILLI.format('sum(ox) OVER w')} AS tx FROM c WINDOW w AS (PARTITION BY seq_id ORDER BY idx)""")
def pose_graph(spark, d):
    """IT11: steps along a line that drift, and a loop from the first to the last pose whose error the least squares share out evenly."""
    w = Window.partitionBy("seq_id").orderBy("idx")
    t = W.trajectories(spark, d).withColumn("last", F.max("idx").over(Window.partitionBy("seq_id")))
    zero = F.lit(0.0)
    step = t.select("seq_id", "idx", (F.col("tx") - F.coalesce(F.lag("tx").over(w), zero) + 0.1 * (F.col("idx") % 3)).alias("mx"))
    turn = [F.lit(1.0 if c in ("r00", "r11", "r22") else 0.0).alias(c) for c in G.NAMES[:9]]
    steps = step.select("seq_id", (F.col("idx") * 2).alias("k"), F.when(F.col("idx") == 0, "prior").otherwise("odom").alias("kind"), (F.col("idx") - 1).alias("src"), F.col("idx").alias("dst"), F.lit(0.1).alias("sigma"), *turn, F.col("mx").alias("tx"), zero.alias("ty"), zero.alias("tz"))
    loops = t.withColumn("f_tx", F.first("tx").over(w)).filter("idx = last AND idx > 1")
    loops = loops.select("seq_id", (F.col("idx") * 2 + 1).alias("k"), F.lit("loop").alias("kind"), F.lit(0).cast("long").alias("src"), F.col("idx").alias("dst"), F.lit(0.1).alias("sigma"), *turn, (F.col("tx") - F.col("f_tx")).alias("tx"), zero.alias("ty"), zero.alias("tz"))
    out = PG.pose_graph(steps.unionByName(loops), "seq_id", "k")
    return out.select("seq_id", "vertex", _rounded("tx", 1e3).alias("tx"))


@query("SELECT CAST(s AS BIGINT) AS seq_id, CAST(f AS BIGINT) AS frame_id, floor(0.2e0 * f * 10 + 0.5e0) / 10 AS tx, floor(-0.1e0 * f * 10 + 0.5e0) / 10 AS ty, floor(sin(0.002e0 * f) * 1e3 + 0.5e0) / 1e3 AS r10 FROM (SELECT unnest(range(4)) AS s), (SELECT unnest(range(4)) AS f)")
def odometry(spark, d):
    """IT8: four sequences of a cloud seen from known poses."""
    base = W.points(spark, d).filter("frame_id < 4").withColumnRenamed("frame_id", "seq_id")
    seen = base.withColumn("frame_id", F.explode(F.expr("sequence(0L, 3L)")))
    f = F.col("frame_id")
    pose = G.inverse(G.from_euler(F.lit(0.0), F.lit(0.0), f * 0.002) | {"tx": f * 0.2, "ty": f * -0.1})
    x, y, z = G.apply(pose, F.col("x"), F.col("y"), F.col("z"))
    found = S.odometry(seen.withColumns({"x": x, "y": y, "z": z}), voxel=1.0, low=1.0)
    return found.select("seq_id", "frame_id", _rounded("tx", 10).alias("tx"), _rounded("ty", 10).alias("ty"), _rounded("r10", 1e3).alias("r10"))


# Sinks.


_QUATERNION = "CASE WHEN 2 + 2 * cos(yaw) >= 2 - 2 * cos(yaw) THEN sqrt(2 + 2 * cos(yaw)) / 2 ELSE 2 * sin(yaw) / (2 * sqrt(2 - 2 * cos(yaw))) END AS qw, CASE WHEN 2 + 2 * cos(yaw) >= 2 - 2 * cos(yaw) THEN 2 * sin(yaw) / (2 * sqrt(2 + 2 * cos(yaw))) ELSE sqrt(2 - 2 * cos(yaw)) / 2 END AS qz"


@query(f"""WITH {W.POSES}, q AS (SELECT *, {_QUATERNION} FROM o) SELECT o_orderkey, printf('%.4f %.4f %.4f 0.0000 0.0000 0.0000 %.4f %.4f', CAST(o_orderkey AS DOUBLE), tx, ty, qz, qw) AS line FROM q""")
def stamped_rows(spark, d):
    o = W.poses(spark, d)
    return scans.stamped_lines(o.select("o_orderkey", *[c.alias(n) for n, c in W.pose_of(o).items()]), "o_orderkey").withColumnRenamed("value", "line")


@query(f"""WITH {W.POSES}, z AS (SELECT '0.000000e+00' AS z, '1.000000e+00' AS e) SELECT o_orderkey, concat_ws(' ', printf('%.6e', cos(yaw)), printf('%.6e', -sin(yaw) + 0e0), z, printf('%.6e', tx), printf('%.6e', sin(yaw)), printf('%.6e', cos(yaw)), z, printf('%.6e', ty), z, z, e, z) AS value FROM o, z""")
def kitti_rows(spark, d):
    o = W.poses(spark, d)
    return scans.pose_lines(o.select("o_orderkey", *[c.alias(n) for n, c in W.pose_of(o).items()]), "o_orderkey")


from cairn.plans import more, sensing  # noqa: E402, F401
