"""Further queries over the driver's tables; they join those of the catalogue."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import vectors as V
from cairn.operators import metrics as M
from cairn.operators import neighbours as N
from cairn.operators import points as P
from cairn.operators import solvers as S
from cairn.operators import temporal as T
from cairn.plans import views as W
from cairn.plans.catalogue import _AS, _BEST, _CELLS, _FIRST, _IN, _V, _queries, _xyz, _XYZ, query
from cairn.plans.views import r6, s6

_OFFSETS = ", ".join(f"({k}, {float(x)!r}e0, {float(y)!r}e0)" for k, (x, y) in G.OFFSETS.items())


@query(f"""WITH {W.POSES}, k AS (SELECT * FROM (VALUES {_OFFSETS}) AS t(scene, dx, dy)) SELECT o_orderkey, {s6('tx + coalesce(dx, 0)')} AS tx, {s6('ty + coalesce(dy, 0)')} AS ty FROM o LEFT JOIN k ON o_orderkey % 26 = scene""")
def scene_offsets(spark, d):
    """SE23."""
    o = W.poses(spark, d)
    x, y = G.with_offset(F.col("o_orderkey") % 26, F.col("tx"), F.col("ty"))
    return o.select("o_orderkey", r6(x).alias("tx"), r6(y).alias("ty"))


@query(f"""WITH {W.POINTS}, q AS (SELECT pt_id, (x + 25) / 10 AS r, y / 20 AS a, z / 10 AS e FROM p) SELECT pt_id, {s6('sin(a) * cos(e) * r')} AS x, {s6('-cos(a) * cos(e) * r')} AS y, {s6('sin(e) * r - 0.090805e0')} AS z FROM q WHERE r > 1""")
def raw_ranges(spark, d):
    """PR16."""
    x, y, z = G.from_ranges((F.col("x") + 25) / 10, F.col("y") / 20, F.col("z") / 10)
    return W.points(spark, d).select("pt_id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z")).filter("x IS NOT NULL")


@query(f"""WITH {W.POINTS}, q AS (SELECT *, -(frame_id % 8) * 2 * {math.pi!r} / 8 AS a FROM p) SELECT pt_id, {s6('cos(a) * x - sin(a) * y')} AS x, {s6('sin(a) * x + cos(a) * y')} AS y FROM q""")
def sector_turn(spark, d):
    """SE15."""
    x, y = G.turn_back(F.col("x"), F.col("y"), F.col("frame_id") % 8, 8)
    return W.points(spark, d).select("pt_id", r6(x).alias("x"), r6(y).alias("y"))


@query(f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, {s6("CASE WHEN label % 3 = 0 THEN 0 ELSE list_sum(v) END")} AS total FROM e""")
def image_mask(spark, d):
    """PR8."""
    e = W.table(spark, d, "embeddings")
    return e.select("vec_id", r6(V.total(V.masked(F.col("embedding"), F.col("label") % 3 == 0))).alias("total"))


_CLASSES = [(120.0, 130.0, 125.0), (150.0, 110.0, 140.0)]


@query(f"""WITH {W.POINTS}, c AS (SELECT * FROM (VALUES (0, 120e0, 130e0, 125e0), (1, 150e0, 110e0, 140e0)) AS t(class, cr, cg, cb)), q AS (SELECT pt_id, 125 + 4 * x AS r, 125 + 2 * y AS g, 125 + 10 * z AS b FROM p)
SELECT pt_id, CAST(class AS INT) AS class FROM q, c WHERE sqrt((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb)) < 50""")
def colour_classes(spark, d):
    """PR7."""
    p = W.points(spark, d).select("pt_id", (125 + 4 * F.col("x")).alias("r"), (125 + 2 * F.col("y")).alias("g"), (125 + 10 * F.col("z")).alias("b"))
    return P.with_colour(p, _CLASSES).select("pt_id", "class")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 11 <> 0")
def nan_poses(spark, d):
    """PR11: every ninth place is NaN, every eleventh null."""
    k = F.col("o_orderkey")
    o = W.poses(spark, d).withColumn("tx", F.when(k % 9 == 0, float("nan")).when(k % 11 != 0, F.col("tx")))
    return P.without_nan(o, "tx", "ty").select("o_orderkey")


@query(f"WITH {W.TRAJECTORIES} SELECT seq_id, idx FROM tr WHERE idx >= 5 AND idx < 25")
def frame_slice(spark, d):
    """PR19."""
    return P.frames_from(W.trajectories(spark, d), "idx", 5, 20).select("seq_id", "idx")


@query(f"WITH {W.POINTS} SELECT pt_id FROM p WHERE pt_id % 3 <> 0")
def snap_filter(spark, d):
    """PR12: one pair in three ends a centimetre beside its cloud."""
    p = W.points(spark, d)
    off = F.when(F.col("pt_id") % 3 == 0, 0.01).otherwise(0.0)
    pairs = p.select("pt_id", "frame_id", *[F.col(c).alias(f"s{c}") for c in "xyz"], (F.col("x") + off).alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    return N.snapped(pairs, p, p, 0.001, "frame_id").select("pt_id")


@query(f"WITH {W.POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y DESC, pt_id) AS n, count(*) OVER (PARTITION BY frame_id) AS c FROM p) SELECT frame_id, pt_id FROM r WHERE n <= floor(c * 0.1e0)")
def seed_ratio(spark, d):
    """TK4."""
    return M.seeds(W.points(spark, d), "frame_id", "y", "pt_id").select("frame_id", "pt_id")


@query(f"""WITH e AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY label, dim ORDER BY v DESC) AS n FROM e)
SELECT label, CAST(dim AS INT) AS dim, CAST(n AS INT) AS rank, {s6('v')} AS v FROM k WHERE n <= 2""")
def k_max_pool(spark, d):
    """AG15."""
    e = W.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("v", F.col("x").cast("double"))
    return M.k_max(e, "label", "dim", "v", 2).select("label", "dim", "rank", r6(F.col("v")).alias("v"))


@query("""WITH k AS (SELECT l_returnflag, l_linenumber AS r, l_suppkey % 5 AS c, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey % 5) AS n FROM lineitem) SELECT l_returnflag, r, c, v FROM k WHERE n = 1""")
def argmax_cell(spark, d):
    """AG23."""
    rows = W.table(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("r"), (F.col("l_suppkey") % 5).alias("c"), F.col("l_extendedprice").alias("v"))
    return M.largest_cell(rows, "r", "c", "v", "l_returnflag")


@query(f"WITH {W.DESCRIPTORS}, {_BEST} SELECT {s6('avg(sim)')} AS mean, count(*) AS n FROM n")
def mean_similarity(spark, d):
    """AG20: no gate."""
    found = N.similarity_top(*W.descriptors(spark, d))
    return M.mean_similarity(found).select(r6(F.col("mean")).alias("mean"), "n")


@query(f"SELECT event_type AS metric, {s6('avg(value)')} AS mean, count(*) AS n FROM events GROUP BY event_type")
def metric_means(spark, d):
    """AG22."""
    e = W.table(spark, d, "events").select(F.col("user_id").alias("seq"), F.col("event_type").alias("metric"), "value")
    return M.mean_by_metric(e).select("metric", r6(F.col("mean")).alias("mean"), "n")


_TEXT = [((i * 37) % 11 - 5) / 10 for i in range(64)]
_TEXT_SQL = "[" + ", ".join(f"{x!r}e0" for x in _TEXT) + "]"


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {_TEXT_SQL} AS t FROM embeddings) SELECT vec_id, {s6('list_inner_product(v, t) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(t, t)))')} AS sim FROM e WHERE len(list_filter(v, lambda x: x = 0)) = 0""")
def text_similarity(spark, d):
    """AG24."""
    e = W.table(spark, d, "embeddings").select("vec_id", V.similarity_to(F.col("embedding"), _TEXT).alias("sim"))
    return e.filter("sim IS NOT NULL").select("vec_id", r6(F.col("sim")).alias("sim"))


_ERR = f"{W.ERRORS}, r AS (SELECT *, rte < 0.3 AND rre < 15 AS success FROM er)"


@query(f"""WITH {_ERR} SELECT method, method || chr(9) || printf('%.2f$\\pm$%.2f', avg(rte), stddev_pop(rte)) || ' & ' || printf('%.2f$\\pm$%.2f', avg(rre), stddev_pop(rre)) || ' & ' || printf('%.2f', 100 * avg(CAST(success AS DOUBLE))) AS line FROM r GROUP BY method""")
def report_table(spark, d):
    """SK6."""
    return M.report_lines(W.errors(spark, d).withColumn("success", (F.col("rte") < 0.3) & (F.col("rre") < 15)))


@query(f"""WITH {W.TRAJECTORIES}, s AS (SELECT seq_id, idx, sum(0.02e0) OVER (PARTITION BY seq_id ORDER BY idx) - 0.02e0 AS y, 1 + 0.01e0 * value AS f FROM tr)
SELECT seq_id, idx, {s6('sum(cos(y) * f - sin(y) * 0.5e0) OVER w')} AS tx, {s6('sum(sin(y) * f + cos(y) * 0.5e0) OVER w')} AS ty, {s6('cos(y + 0.02e0)')} AS r00 FROM s WINDOW w AS (PARTITION BY seq_id ORDER BY idx)""")
def pose_product(spark, d):
    """AG13: steps forward and aside with a constant turn, multiplied up."""
    t = W.trajectories(spark, d)
    step = G.from_euler(F.lit(0.0), F.lit(0.0), F.lit(0.02)) | {"tx": 1 + 0.01 * F.col("value"), "ty": F.lit(0.5), "tz": F.lit(0.0)}
    out = T.accumulated(t.select("seq_id", "idx", *[c.alias(n) for n, c in step.items()]), "seq_id", "idx")
    return out.select("seq_id", "idx", *[r6(F.col(c)).alias(c) for c in ("tx", "ty", "r00")])


_SAMPLES = f"{_AS}, lo AS (SELECT q.seq_id, q.q, q.t, max(sm.t) FILTER (sm.t <= q.t) AS lo, min(sm.t) FILTER (sm.t > q.t) AS hi FROM q JOIN sm ON q.seq_id = sm.seq_id GROUP BY ALL), ip AS (SELECT lo.seq_id, q, lo.t, a.value + (lo.t - lo) / (hi - lo) * (b.value - a.value) AS v, (a.value - floor(a.value)) + (lo.t - lo) / (hi - lo) * ((b.value - floor(b.value)) - (a.value - floor(a.value))) AS y FROM lo JOIN sm a ON a.seq_id = lo.seq_id AND a.t = lo.lo JOIN sm b ON b.seq_id = lo.seq_id AND b.t = lo.hi)"


def _posed(spark, d):
    """Queries, and samples whose turn about z is the fraction of their value."""
    q, s = _queries(spark, d)
    half = (F.col("value") - F.floor("value")) / 2
    zero = F.lit(0.0)
    return q, s.select("seq_id", "t", F.col("value").alias("tx"), zero.alias("ty"), zero.alias("tz"), F.cos(half).alias("qw"), zero.alias("qx"), zero.alias("qy"), F.sin(half).alias("qz"))


@query(f"WITH {_SAMPLES} SELECT seq_id, q, t, {s6('v')} AS tx, {s6('cos(y / 2)')} AS qw, {s6('sin(y / 2)')} AS qz FROM ip")
def pose_interpolate(spark, d):
    """SE7, AS5: places on a line, turns along the shorter arc."""
    out = T.interpolate_poses(*_posed(spark, d), "seq_id")
    return out.select("seq_id", "q", "t", *[r6(F.col(c)).alias(c) for c in ("tx", "qw", "qz")])


@query(f"""WITH {_SAMPLES}, b AS (SELECT min(t) AS a, max(t) AS z FROM tr), k AS (SELECT ip.*, q % 10 + 1 AS x, q % 7 AS w FROM ip, b WHERE t BETWEEN a + (z - a) // 4 AND a + 3 * ((z - a) // 4))
SELECT seq_id, q, t, {s6('cos(y) * x - sin(y) * w + v')} AS x, {s6('sin(y) * x + cos(y) * w')} AS y FROM k""")
def built_cloud(spark, d):
    """AS6: the middle half of the time, a sensor one metre ahead of the vehicle."""
    q, s = _posed(spark, d)
    ends = W.trajectories(spark, d).agg(F.min("t").alias("a"), F.max("t").alias("z")).collect()[0]
    quarter = (ends["z"] - ends["a"]) // 4
    scans = q.select("seq_id", "q", "t", (F.col("q") % 10).cast("double").alias("x"), (F.col("q") % 7).cast("double").alias("y"), F.lit(1.0).alias("z"))
    out = T.build_cloud(scans, s, "seq_id", ends["a"] + quarter, ends["a"] + 3 * quarter, G.identity() | {"tx": F.lit(1.0)})
    return out.select("seq_id", "q", "t", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"""WITH {W.TRAJECTORIES}, s AS (SELECT seq_id, idx AS scan, tx, ty FROM tr WHERE idx % 10 = 0), j AS (SELECT a.seq_id, a.idx AS q, s.scan, row_number() OVER (PARTITION BY a.seq_id, a.idx ORDER BY (a.tx - s.tx) * (a.tx - s.tx) + (a.ty - s.ty) * (a.ty - s.ty), s.scan) AS n FROM tr a JOIN s ON a.seq_id = s.seq_id) SELECT seq_id, q, scan FROM j WHERE n = 1""")
def nearest_scan(spark, d):
    """JN22."""
    t = W.trajectories(spark, d)
    places = t.select("seq_id", F.col("idx").alias("q"), "tx", "ty", "tz")
    return N.nearest_scan(places, t.filter("idx % 10 = 0").select("seq_id", F.col("idx").alias("scan"), "tx", "ty", "tz"), "seq_id")


@query(f"""WITH {_CELLS}, {_IN}, g AS (SELECT src_id, list(tgt_id ORDER BY tgt_id)[1:3] AS l FROM h GROUP BY src_id), z AS (SELECT src_id, unnest([0, 1, 2]) AS slot, l FROM g), w AS (SELECT src_id, CAST(slot AS INT) AS slot, coalesce(l[slot + 1], l[1]) AS tgt_id FROM z)
SELECT src_id, slot, {s6('t.x - s.x')} AS dx, {s6('t.y - s.y')} AS dy, {s6('t.z - s.z')} AS dz FROM w JOIN p t ON t.pt_id = tgt_id JOIN p s ON s.pt_id = src_id""")
def grouped_points(spark, d):
    """JN18: the neighbours of each point seen from it."""
    p = W.points(spark, d)
    out = N.ball_group(p, p, 1.0, 1.0, 3, "frame_id")
    return out.select("src_id", "slot", *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "dz")])


@query(f"""WITH {W.POINTS}, k0 AS (SELECT *, {_V.format('2e0')} FROM p WHERE x - 3 > 0), f0 AS (SELECT pt_id, frame_id, x, y, z FROM ({_FIRST.format(k='vx, vy, vz', t='k0')})),
m AS (SELECT pt_id, frame_id // 5 AS scene, cos(0.1e0 * frame_id) * x - sin(0.1e0 * frame_id) * y + frame_id AS x, sin(0.1e0 * frame_id) * x + cos(0.1e0 * frame_id) * y AS y, z FROM f0),
k1 AS (SELECT *, {_V.format('2e0')} FROM m) SELECT scene, pt_id, {_XYZ} FROM (SELECT *, row_number() OVER (PARTITION BY scene, vx, vy, vz ORDER BY pt_id) AS n FROM k1) WHERE n = 1""")
def map_build(spark, d):
    """VX8: points with a descriptor, thinned, placed by the pose of their frame, thinned again."""
    p = W.points(spark, d).withColumn("desc", F.array(F.col("x"), F.lit(-3.0)))
    frames = p.select("frame_id").distinct()
    pose = G.from_euler(F.lit(0.0), F.lit(0.0), F.col("frame_id") * 0.1) | {"tx": F.col("frame_id").cast("double"), "ty": F.lit(0.0), "tz": F.lit(0.0)}
    poses = frames.select("frame_id", F.floor(F.col("frame_id") / 5).alias("scene"), *[c.alias(n) for n, c in pose.items()])
    return _xyz(P.map_build(p, poses, 2.0, "frame_id", "scene"), "scene", "pt_id")


_W = 0.2
_A, _B = math.sin(_W) / _W, (1 - math.cos(_W)) / _W
_RX, _RY = _A * 2 / (_A * _A + _B * _B), -_B * 2 / (_A * _A + _B * _B)


@query(f"""WITH {W.POINTS}, r AS (SELECT pt_id, x, y, 0.5e0 * (1 - atan2(y, x) / pi()) - 0.5e0 AS s FROM p), k AS (SELECT *, s * {_W!r} AS w FROM r), v AS (SELECT *, CASE WHEN abs(w) < 1e-9 THEN 1 ELSE sin(w) / w END AS a, CASE WHEN abs(w) < 1e-9 THEN 0 ELSE (1 - cos(w)) / w END AS b FROM k)
SELECT pt_id, {s6(f'cos(w) * x - sin(w) * y + s * (a * {_RX!r} - b * {_RY!r})')} AS x, {s6(f'sin(w) * x + cos(w) * y + s * (b * {_RX!r} + a * {_RY!r})')} AS y FROM v""")
def deskew_points(spark, d):
    """WN8: a sweep during two metres of way and a turn of 0.2."""
    start = G.identity()
    finish = G.from_euler(F.lit(0.0), F.lit(0.0), F.lit(_W)) | {"tx": F.lit(2.0)}
    out = P.deskewed(W.points(spark, d), start, finish, G.yaw_time(F.col("x"), F.col("y")))
    return out.select("pt_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query()
def pca_rgb(spark, d):
    """AG17."""
    found = S.principal_colours(W.table(spark, d, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", *[F.col("colour")[i].alias(c) for i, c in enumerate("rgb")])
